"""Rule tables: vocabularies, weights, thresholds and allowed combinations. All are fixed values that results depend on."""

from __future__ import annotations

# Applicability gate: bands, weights and vocabularies.
GATE_BANDS = [(0.70, "mapek_recovery_enabled"), (0.40, "needs_review")]
GATE_WEIGHTS = {"SAS-GATE-01": 0.20, "SAS-GATE-02": 0.25, "SAS-GATE-03": 0.15, "SAS-GATE-04": 0.15, "SAS-GATE-05": 0.15, "SAS-GATE-06": 0.10}
AUTONOMIC_TERMS = ["adapt", "adaptive", "adaptation", "autonomic", "selfadaptive", "self_adaptive", "self-adaptive", "feedback", "feedbackloop", "controlloop", "mape", "mapek", "reconfigure", "reconfiguration"]
ROLE_TERMS = {"monitor": "Monitor", "analyzer": "Analyzer", "analyser": "Analyzer", "planner": "Planner", "executor": "Executor", "knowledge": "Knowledge", "sensor": "Sensor", "effector": "Effector"}
SENSOR_TERMS = ["sensor", "probe", "metric", "measure", "measurement", "collect", "observe", "status", "runtime", "telemetry"]
EFFECTOR_TERMS = ["effector", "actuator", "execute", "apply", "reconfigure", "adapt", "restart", "scale", "change", "deploy"]
KNOWLEDGE_TERMS = ["knowledge", "context", "runtime_model", "model", "state", "repository", "history", "log"]
GATE_MIN_ROLES = 3

# Role inference: (role, name terms, method terms, decorator terms), in order of precedence.
ROLE_RULES = [
    ("Monitor", ["monitor"], ["collect", "observe", "measure", "read", "get_status"], ["monitor"]),
    ("Analyzer", ["analyzer", "analyser"], ["analyze", "analyse", "detect", "evaluate", "diagnose"], ["analyze", "analyse", "analyzer", "analyser"]),
    ("Planner", ["planner"], ["plan", "select", "decide", "choose", "strategy"], ["plan", "planner"]),
    ("Executor", ["executor"], ["execute", "apply", "reconfigure", "adapt", "restart"], ["execute", "executor"]),
    ("Knowledge", ["knowledge"], ["store", "update", "query", "remember", "record"], ["knowledge"]),
    ("Sensor", ["sensor", "probe"], ["read", "sense", "collect", "measure"], ["sensor", "probe"]),
    ("Effector", ["effector", "actuator"], ["actuate", "apply", "change", "execute"], ["effector", "actuator"]),
    ("ReferenceInput", ["reference", "goal", "threshold", "target"], ["threshold", "target", "goal"], ["reference", "goal", "threshold", "target"]),
    ("Alternative", ["alternative", "strategy", "plan"], ["strategy", "alternative", "plan"], ["alternative", "strategy"]),
    ("LoopManager", ["loop", "coordinator", "manager"], ["run_loop", "coordinate", "orchestrate", "adapt"], ["loop"]),
]
#: Terms in the names of called functions that hint at the caller's role.
HINT_TERMS = {
    "Monitor": ["analyze", "analyser", "analyzer", "knowledge", "sensor"], "Analyzer": ["plan", "planner", "knowledge", "symptom"], "Planner": ["execute", "executor", "alternative", "strategy"],
    "Executor": ["effector", "actuator", "apply", "reconfigure"], "Knowledge": ["monitor", "analyzer", "planner", "executor"], "Sensor": ["monitor"], "Effector": ["executor"],
    "LoopManager": ["monitor", "analyzer", "planner", "executor"],
}
DECORATOR_ROLES = {"monitor": "Monitor", "analyze": "Analyzer", "analyse": "Analyzer", "plan": "Planner", "execute": "Executor"}
REGISTRATION_ROLES = {"loop.monitor": "Monitor", "loop.analyze": "Analyzer", "loop.analyse": "Analyzer", "loop.plan": "Planner", "loop.execute": "Executor"}
NAME_WEIGHT, PATH_WEIGHT, METHOD_WEIGHT, METHOD_MOST, CALL_WEIGHT = 0.45, 0.20, 0.10, 0.25, 0.10
DECORATOR_CONFIDENCE, REGISTRATION_CONFIDENCE = 0.95, 0.85
STATUS_BANDS = [(0.85, "auto_accepted"), (0.60, "needs_review")]
WEAK = "weak_suggestion"
PROMOTE_FROM, NEVER_PROMOTED = 0.60, ("Alternative",)

# Control inputs and outputs: (role, confidence, name terms), in order of precedence.
CONTROL_RULES = [
    ("ReferenceInput", 0.90, ["reference", "setpoint", "set_point", "target", "goal", "desired", "threshold"]),
    ("MeasuredOutput", 0.80, ["measured", "measurement", "current", "actual", "observed", "distance", "speed", "position", "temperature", "pressure", "level", "angular", "rpm"]),
    ("Sensor", 0.85, ["sensor", "read", "measure", "capture", "observe", "sample", "tachometer", "proximity", "camera", "gps"]),
    ("Effector", 0.85, ["effector", "actuator", "actuate", "apply", "execute", "brake", "gas", "accelerate", "steer", "wheel", "motor", "servo", "siren", "hazard", "light"]),
]
#: Kinds of elements among which each role is looked for.
CONTROL_KINDS = {
    "ReferenceInput": ["variable", "attribute", "parameter"], "MeasuredOutput": ["variable", "attribute", "parameter"],
    "Sensor": ["class", "method", "function", "variable", "attribute"], "Effector": ["class", "method", "function", "variable", "attribute"],
}
CONTROL_CAPS = {"ReferenceInput": 8, "MeasuredOutput": 10, "Sensor": 10, "Effector": 10}
CONTROL_EXCLUDED_NAMES = [
    "__init__", "__del__", "__getattr__", "__getitem__", "__iter__", "__call__", "__setattr__", "init", "del", "getattr", "getitem", "iter", "call", "repr", "create", "setup", "load", "get", "set",
    "start", "stop", "dispose", "subscribe", "unsubscribe", "on_next", "on_error", "on_completed", "handler", "decorator", "wrapped", "contains", "register", "add_loop", "has_loop", "add_element",
    "has_element", "add_to_loop", "add_to_app", "add_to_level",
]
CONTROL_EXCLUDED_PATHS = [
    ".mape.", "_mape_", "mape/", ".utils.", "_utils_", "utils/", ".remote.", "_remote_", "remote/", ".typing.", "_typing_", "typing/", ".base_elements.", "_base_elements_", "base_elements/", ".config.", "_config_", "config/",
]

# Roles, relationship kinds and what may hold what.
CORE_ROLES = ["Monitor", "Analyzer", "Planner", "Executor"]
ROLE_ORDER = {"Monitor": 1, "Analyzer": 2, "Planner": 3, "Executor": 4, "Knowledge": 5}
MANAGING_ROLES = ["Monitor", "Analyzer", "Planner", "Executor", "Knowledge", "LoopManager", "ReferenceInput"]
MANAGED_ROLES = ["Sensor", "Effector", "MeasuredOutput"]
LOOP_ROLES = ["Monitor", "Analyzer", "Planner", "Executor", "Knowledge", "ReferenceInput"]
ALLOWED_ROLES = ["Monitor", "Analyzer", "Planner", "Executor", "Knowledge", "LoopManager", "Loop", "ReferenceInput", "MeasuredOutput", "Sensor", "Effector", "ManagedElement", "Alternative"]
ALLOWED_RELATIONS = [
    "contains", "mapek_flow", "uses_knowledge", "subscribes_to", "depends_on", "controls", "observes", "updates", "acts_through", "observes_through", "produces_measurement", "uses_reference_input", "evaluates_measured_output",
]
STANDARD_FLOW = [("Monitor", "Analyzer"), ("Monitor", "Planner"), ("Analyzer", "Planner"), ("Planner", "Executor")]
BOUNDARY_PAIRS = [
    ("Executor", "Effector", "acts_through"), ("Monitor", "Sensor", "observes_through"), ("Sensor", "MeasuredOutput", "produces_measurement"),
    ("Planner", "ReferenceInput", "uses_reference_input"), ("Analyzer", "ReferenceInput", "uses_reference_input"), ("Analyzer", "MeasuredOutput", "evaluates_measured_output"),
]
#: Roles between which a runtime call suggests a relationship.
DYNAMIC_PAIRS = [
    ("Executor", "Effector", "acts_through"), ("Monitor", "Sensor", "observes_through"), ("Monitor", "MeasuredOutput", "observes"), ("Sensor", "MeasuredOutput", "produces_measurement"),
    ("Analyzer", "ReferenceInput", "uses_reference_input"), ("Planner", "ReferenceInput", "uses_reference_input"),
    ("Analyzer", "MeasuredOutput", "evaluates_measured_output"), ("Planner", "MeasuredOutput", "evaluates_measured_output"),
]
FLOW_CONFIDENCE, KNOWLEDGE_CONFIDENCE, CONTAINS_CONFIDENCE, SUBSCRIBE_CONFIDENCE = 0.75, 0.80, 0.90, 0.85
#: Stereotypes of the family "Adaptive System Domain" by role.
STEREOTYPES = {
    "Monitor": "Monitor", "Analyzer": "Analyzer", "Planner": "Planner", "Executor": "Executor", "Knowledge": "Knowledge", "LoopManager": "Control Loop Manager", "Loop": "Control Loop", "ReferenceInput": "Reference Input",
    "MeasuredOutput": "Measured Output", "Sensor": "Sensor", "Effector": "Effector", "ManagedElement": "Managed Element", "Alternative": "Alternative",
}
SINGLE_ROLES = ["Analyzer", "Planner", "Knowledge"]

# Builtin and external types: methods with their return types (unknown: not followed), and factories.
BUILTIN_METHODS = {
    "list": {"append": "NoneType", "extend": "NoneType", "insert": "NoneType", "remove": "NoneType", "pop": "unknown", "clear": "NoneType", "index": "int", "count": "int", "sort": "NoneType", "reverse": None, "copy": "list"},
    "dict": {"get": "unknown", "keys": "dict_keys", "values": "dict_values", "items": "dict_items", "update": "NoneType", "pop": "unknown", "clear": "NoneType", "copy": "dict", "setdefault": "unknown"},
    "str": {"strip": "str", "lstrip": "str", "rstrip": "str", "title": "str", "lower": "str", "upper": "str", "replace": "str", "split": "list", "join": "str", "startswith": "bool", "endswith": "bool", "find": "int", "format": "str"},
    "set": {"add": "NoneType", "remove": "NoneType", "discard": "NoneType", "pop": "unknown", "clear": "NoneType", "union": "set", "intersection": "set", "difference": "set", "copy": "set"},
    "tuple": {"count": "int", "index": "int"},
    "int": {"bit_length": "int", "to_bytes": "bytes"},
    "float": {"is_integer": "bool", "hex": "str"},
    "bool": {},
    "NoneType": {},
}
FACTORIES = {"logging.getLogger": "logging.Logger", "logging.Logger": "logging.Logger", "Path": "pathlib.Path", "open": "io.TextIOWrapper", "requests.get": "requests.Response", "pandas.DataFrame": "pandas.DataFrame"}
EXTERNAL_METHODS = {
    "logging.Logger": ["debug", "info", "warning", "error", "exception", "critical", "log", "setLevel", "addHandler", "removeHandler"],
    "pathlib.Path": ["exists", "is_file", "is_dir", "read_text", "write_text", "mkdir", "glob", "resolve", "joinpath"],
    "io.TextIOWrapper": ["write", "read", "readline", "readlines", "close", "flush"],
    "requests.Response": ["json", "text", "raise_for_status"],
    "pandas.DataFrame": ["head", "tail", "to_csv", "drop", "merge", "groupby"],
}
