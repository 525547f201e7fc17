"""Fixed values that must equal the analysed tool's own tables for equal results.

FIXED VALUES -- listed plainly, in their natural order. The layer and concept
dictionaries are turned into small dimension DataFrames by
``archspark.sources.dims``; users may pass their own tables instead.
"""

# FIXED VALUES: directory names that exclude a path from the inventory.
IGNORED_DIRS = [
    ".git", ".venv", "venv", "env", "node_modules",
    "build", "dist", "__pycache__", ".idea", ".vscode",
    ".pytest_cache",
]

# FIXED VALUES: file names that mark an entry point.
ENTRY_POINT_NAMES = [
    "main.py", "app.py", "wsgi.py", "run.py", "server.py", "asgi.py",
    "index.js", "server.js", "app.js", "main.js",
    "index.tsx", "index.jsx", "main.tsx",
]

# FIXED VALUES: suffixes of code files counted by the temporal matrix.
CODE_SUFFIXES = [".py", ".js", ".ts", ".go", ".java", ".cpp", ".cs"]

# FIXED VALUES: suffixes of database files.
DATABASE_SUFFIXES = [".db", ".sqlite", ".sqlite3"]

# FIXED VALUES: JavaScript-family extensions.
JS_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]

# FIXED VALUES: framework names searched (in this order) in the joined dependency string.
FRAMEWORKS = [("fastapi", "FastAPI"), ("flask", "Flask"), ("react", "React"),
              ("vue", "Vue"), ("django", "Django")]

# FIXED VALUES: requirement version separators.
REQUIREMENT_SEPARATORS = ["==", ">=", "<=", "~="]

# FIXED VALUES: layer dictionary, in declaration order (the order breaks ties).
FALLBACK_LAYER = "Core Runtime Layer"
LAYERS = [
    ("IDE Layer", ["max_ide", "void", "mde", "editor", "code_analyzer"]),
    ("UI Layer", ["static", "css", "html", "js", "panel", "window", "overlay", "view", "mr_r_", "ui"]),
    ("Voice Layer", ["tts", "stt", "voice", "speech", "audio", "sound", "sounddevice", "listener", "listening"]),
    ("Research Layer", ["research", "diagnostic", "lab"]),
    ("Database Layer", ["db", "database", "sql", "postgres", "cosmos", "repository", "model", "orm", "storage", "query"]),
    ("Authentication Layer", ["auth", "login", "jwt", "session", "credential", "security", "secrets", "password"]),
    ("Scheduling Layer", ["scheduler", "alarm", "cron", "timer", "schedule"]),
    ("LLM Layer", ["llm", "gpt", "openai", "claude", "prompt", "ai_command", "predictor", "learner", "agent", "intelligence"]),
    ("Core Runtime Layer", []),
]

# FIXED VALUES: exclusive path rules (first match wins) and extension rules
# (first match wins), as (order, layer, regex on the lower-cased path, points).
PATH_RULES = [
    (1, "IDE Layer", "static/tools/max_ide|void-main", 12),
    (2, "UI Layer", "static/|templates/", 8),
    (3, "Voice Layer", "stt/|tts/", 8),
    (4, "Research Layer", "research_lab", 8),
]
EXT_RULES = [
    (1, "IDE Layer", "(max_ide|void).*[.](tsx|jsx)$", 6),
    (2, "UI Layer", "[.](tsx|jsx)$", 5),
    (3, "UI Layer", "[.](css|html)$", 6),
]
DATABASE_FILE_POINTS = ("Database Layer", 12)
ROUTE_HANDLER_POINTS = ("UI Layer", 3)

# FIXED VALUES: goal keyword -> concepts.
_AUTH = ["auth", "jwt", "login", "token", "middleware", "identity", "session", "authentication", "authorization"]
_UI = ["ui", "frontend", "react", "tsx", "editor", "sidebar", "settings", "theme", "max ide", "widgets"]
_DB = ["database", "postgres", "sql", "repository", "orm", "storage", "query", "cosmos"]
_SPLIT = ["user", "service", "api", "boundary", "database", "repository", "authentication", "microservice"]
CONCEPT_MAP = [
    ("jwt", _AUTH), ("auth", _AUTH), ("login", _AUTH), ("authentication", _AUTH),
    ("ui", _UI), ("frontend", _UI), ("ide", _UI), ("editor", _UI), ("sidebar", _UI),
    ("postgres", _DB), ("postgresql", _DB), ("cosmos", _DB), ("database", _DB), ("db", _DB),
    ("microservice", _SPLIT), ("split", _SPLIT),
]

# FIXED VALUES: words dropped from goals.
STOP_WORDS = ["add", "change", "replace", "with", "into", "a", "an", "the", "to",
              "for", "in", "of", "on", "and", "or"]

# FIXED VALUES: concept vocabularies that select target layers, in order.
LAYER_VOCAB = [
    (["IDE Layer", "UI Layer"], _UI),
    (["Authentication Layer"], _AUTH),
    (["Database Layer"], _DB),
    (["Voice Layer"], ["tts", "stt", "voice", "speech", "audio", "sound", "sounddevice", "listener", "listening"]),
    (["Scheduling Layer"], ["scheduler", "cron", "alarm", "timer", "schedule"]),
    (["LLM Layer"], ["llm", "gpt", "openai", "claude", "prompt", "ai_command", "predictor", "learner", "agent", "intelligence"]),
    (["Research Layer"], ["research", "diagnostic", "lab"]),
]

# FIXED VALUES: folders that floor the path part at 22 when a UI concept is present.
UI_FLOOR_FOLDERS = ["max_ide", "void-main"]
UI_FLOOR_CONCEPTS = ["ui", "editor", "ide", "sidebar"]
UI_NAME_WORDS = ["ui", "panel", "window", "view", "sidebar", "widget"]

# FIXED VALUES: prompt keyword -> target file, in declaration order.
CHANGE_MAP = [
    ("database", "database.py"), ("postgres", "database.py"), ("postgresql", "database.py"),
    ("db", "database.py"), ("cosmos", "database.py"), ("cosmosdb", "database.py"),
    ("auth", "auth.py"), ("authentication", "auth.py"), ("login", "auth.py"),
    ("entra", "auth.py"), ("entraid", "auth.py"),
    ("jwt", "jwt.py"), ("token", "jwt.py"),
    ("billing", "billing.py"), ("payment", "billing.py"), ("stripe", "billing.py"),
    ("redis", "redis_cache.py"), ("cache", "redis_cache.py"),
    ("session", "session.py"),
    ("user", "user_repo.py"), ("user_repo", "user_repo.py"),
    ("utils", "utils.py"), ("logger", "utils.py"),
]

# FIXED VALUES: risk titles, severities and confidences by detector ordinal.
RISK_OVERSIZED = "Oversized Module / God Object"
RISK_CONTROLLER = "Monolithic Controller"
RISK_CYCLE = "Circular Dependency Loop"
RISK_DEEP = "Deep Dependency Chain"
RISK_ROUTES = "Route Concentration Bottleneck"
RISK_DB = "Direct Database Access in Views"
RISK_TESTS = "Missing Unit Test Coverage"
RISK_CONFIDENCE = {1: 0.95, 2: 0.99, 3: 0.90, 4: 0.95, 5: 0.88, 6: 0.90}

# FIXED VALUES: evidence sentences of an import cycle; the first is followed by its path, nodes joined by the arrow.
CYCLE_EVIDENCE = "AST import path forms a dependency loop: "
CYCLE_ARROW = " -> "
CYCLE_EFFECT = "Causes class loader coupling and initialization order fragility"

# FIXED VALUES: recommendation per risk title (ordinal, title, advice).
ADVICE = [
    (1, RISK_OVERSIZED, "Split functions/methods into smaller cohesive sibling modules."),
    (1, RISK_CONTROLLER, "Split functions/methods into smaller cohesive sibling modules."),
    (2, RISK_CYCLE, "Extract shared variables/classes into a utilities script to resolve circular imports."),
    (3, RISK_DB, "Encapsulate queries inside database model repository helper views."),
]

# FIXED VALUES: goal words that select the plan complexity (first match wins).
PLAN_COMPLEXITY = [
    (["auth", "jwt", "login"], "Medium"),
    (["postgres", "cosmos", "database", "db"], "High"),
    (["redis", "cache"], "Medium"),
]

# FIXED VALUES: (steps, checks) of a plan, in the order of PLAN_COMPLEXITY and then for all other goals; {target} is the
# recommended file, {others} the first two further files it affects.
PLAN_TEXTS = [
    (["Review authentication structure inside `{target}`.",
      "Verify token signatures and signature keys in config files.",
      "Update dependent controllers: {others} to intercept request credentials."],
     ["Assert password hashes are salted and not exposed in `{target}`.",
      "Verify JWT middleware intercepts unauthorized requests."]),
    (["Identify connection settings and queries in `{target}`.",
      "Re-point connection contexts to new Cosmos/NoSQL document collections.",
      "Update schemas and ORM mapping imports in {others}."],
     ["Verify database connection pool initializes successfully from `{target}`.",
      "Bench-test partitioned document query latency."]),
    (["De-reference cache dependencies in `{target}`.",
      "Implement safe thread-locked fallback storage dictionary."],
     ["Verify application starts with zero active Redis servers required.",
      "Assert thread-locked cache eviction runs successfully."]),
    (["Identify logical targets in `{target}`.",
      "Verify static import trees before applying structural changes."],
     ["Verify script builds cleanly on dev environment."]),
]

# FIXED VALUES: numeric thresholds.
LATEST_COMMITS = 150
MIN_COMMIT_SUPPORT = 2
MIN_RATIO_PCT = 10
OVERSIZED_BYTES = 30720
OVERSIZED_FUNCTIONS = 20
CRITICAL_BYTES = 80000
ROUTE_CONCENTRATION = 5
DEEP_CHAIN = 4
MISSING_TEST_MIN_BYTES = 1000
MISSING_TEST_TOP = 4
BLOAT_BYTES = 15360

# FIXED VALUES: keyword -> file map of the prompt-to-file cascade, in declaration order,
# and the default file keys tried when nothing matches.
FILE_KEYWORD_MAP = [
    ("database", "database.py"), ("postgres", "database.py"), ("postgresql", "database.py"),
    ("db", "database.py"), ("cosmos", "database.py"), ("cosmosdb", "database.py"),
    ("auth", "auth.py"), ("authentication", "auth.py"), ("login", "auth.py"),
    ("jwt", "jwt.py"), ("token", "jwt.py"),
    ("billing", "billing.py"), ("payment", "billing.py"),
    ("redis", "redis_cache.py"), ("cache", "redis_cache.py"),
    ("utils", "utils.py"), ("logger", "utils.py"),
]
DEFAULT_TARGET_KEYS = ["auth.py", "database.py", "main.py", "bridge.py", "memory_manager.py"]
