"""Default synonym dictionary of query expansion; callers may pass their own."""

# They decide the expanded queries.
SYNONYMS = {
    "fix": ["repair", "resolve", "troubleshoot"],
    "error": ["bug", "issue", "problem", "fault"],
    "fast": ["quick", "rapid", "speedy"],
    "big": ["large", "huge", "massive"],
    "small": ["tiny", "little", "compact"],
    "start": ["begin", "initiate", "launch"],
    "stop": ["halt", "terminate", "end"],
    "create": ["make", "build", "generate"],
    "delete": ["remove", "destroy", "erase"],
    "help": ["assist", "support", "aid"],
    "use": ["utilize", "employ", "apply"],
    "show": ["display", "present", "reveal"],
    "find": ["locate", "search for", "discover"],
    "run": ["execute", "launch", "start"],
    "set": ["configure", "establish", "setup"],
    "get": ["retrieve", "obtain", "fetch"],
    "update": ["modify", "change", "alter"],
    "check": ["verify", "validate", "inspect"],
    "test": ["validate", "verify", "check"],
    "install": ["set up", "deploy", "configure"],
    "configure": ["setup", "adjust", "tune"],
    "improve": ["enhance", "optimize", "refine"],
    "performance": ["speed", "efficiency", "latency"],
    "security": ["safety", "protection", "auth"],
    "database": ["db", "datastore", "storage"],
    "request": ["call", "invocation", "api call"],
    "response": ["reply", "result", "output"],
    "input": ["parameter", "argument", "value"],
    "output": ["result", "return", "response"],
    "user": ["person", "individual", "end user"],
    "system": ["platform", "environment", "setup"],
    "data": ["information", "records", "content"],
    "file": ["document", "record", "artifact"],
    "function": ["method", "procedure", "routine"],
    "class": ["type", "object", "structure"],
    "variable": ["field", "property", "attribute"],
    "code": ["source", "implementation", "script"],
    "log": ["record", "entry", "event"],
    "message": ["notification", "alert", "communication"],
    "version": ["release", "iteration", "edition"],
    "config": ["configuration", "settings", "setup"],
    "auth": ["authentication", "authorization", "login"],
    "api": ["interface", "endpoint", "contract"],
    "url": ["link", "address", "uri"],
    "path": ["route", "directory", "location"],
    "error message": ["exception", "traceback", "stack trace"],
}
