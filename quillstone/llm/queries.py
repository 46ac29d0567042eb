"""Registered queries of the training-data operators: name -> (session, data directory) -> rows."""

from __future__ import annotations

from . import boilerplate, encoding, history, leakage, neighbours, reading, splitting, tokenizing

QUERIES = {
    "p1_found": history.p1_found,
    "p3_found": encoding.p3_found,
    "p3_restored": encoding.p3_restored,
    "p4_found": splitting.p4_found,
    "p4_pieces": splitting.p4_pieces,
    "p5_found": boilerplate.p5_found,
    "p5_bodies": boilerplate.p5_bodies,
    "p6_found": neighbours.p6_found,
    "p6_neighbours": neighbours.p6_neighbours,
    "p7_ids": tokenizing.p7_ids,
    "p7_decoded": tokenizing.p7_decoded,
    "p8_found": leakage.p8_found,
    "p9_found": reading.p9_found,
}

#: The other operators can't be written as SQL over whole tables, or are approximate; tests
#: hold them against brute force, exact round trips or held-out labels.
SQL: dict[str, str] = {
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS decoded FROM documents",
    "p4_found": """SELECT rec_id FROM doc_registry r JOIN chunking_settings s ON s.settings_id = coalesce(r.settings_id, 1)
        WHERE len(list_filter(string_split_regex(content, '[ \\t\\n\\r]+'), lambda x: x != '')) > s.max_size""",
}
