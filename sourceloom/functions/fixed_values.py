"""Tables, word lists, limits and patterns that define the results."""

# --- languages and comment markers -------------------------------------------------

# extension -> language used for line counting
EXTENSION_LANGUAGE = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "java": "java",
    "cs": "csharp",
    "sql": "sql",
    "c": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "go": "go",
    "rs": "rust",
    "rb": "ruby",
    "php": "php",
    "swift": "swift",
    "kt": "kotlin",
}

# languages whose line comment is not "//"
HASH_COMMENT_LANGUAGES = ("python", "ruby")
DASH_COMMENT_LANGUAGES = ("sql",)

# extensions with full metrics
METRIC_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}

# extensions with declaration rules; one key is used for C#
PARSER_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".cs": "csharp",
    ".sql": "sql",
}

# path endings recognised when a prompt is rendered (case sensitive)
PROMPT_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
}

# --- scanning ----------------------------------------------------------------------

ANALYSIS_EXCLUDES = [
    "**/node_modules/**",
    "**/venv/**",
    "**/.venv/**",
    "**/dist/**",
    "**/build/**",
    "**/__pycache__/**",
    "**/.git/**",
    "**/*.pyc",
    "**/*.min.js",
    "**/*.bundle.js",
]

CONFIG_EXCLUDES = [
    "**/node_modules/**",
    "**/venv/**",
    "**/dist/**",
    "**/build/**",
    "**/__pycache__/**",
    "**/test/**",
    "**/*.test.js",
    "**/*.spec.ts",
]

# --- database files ----------------------------------------------------------------

SQL_EXTENSIONS = (".sql", ".ddl", ".dml")
MIGRATION_DIRECTORIES = ("migrations", "alembic")
MIGRATION_NAME = (
    r"^(?:\d{4}_\d{2}_\d{2}_.*|migration_\d+|.*_migration|\d+_.*|[a-f0-9]{12}_.*)\.py$"
)

# at least two hits make a file an ORM file; tested in this order
ORM_PATTERNS = {
    "django": [
        r"from\s+django\.db\s+import\s+models",
        r"class\s+\w+\s*\(\s*models\.Model\s*\)",
    ],
    "sqlalchemy": [
        r"from\s+sqlalchemy\s+import",
        r"from\s+sqlalchemy\.ext\.declarative\s+import",
        r"class\s+\w+\s*\(\s*Base\s*\)",
        r"__tablename__\s*=",
    ],
    "flask_sqlalchemy": [
        r"from\s+flask_sqlalchemy\s+import",
        r"db\s*=\s*SQLAlchemy",
        r"class\s+\w+\s*\(\s*db\.Model\s*\)",
    ],
}

SQL_TABLE_LEADS = [
    r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?",
    r"FROM\s+",
    r"JOIN\s+",
    r"INSERT\s+INTO\s+",
    r"UPDATE\s+",
]

SQL_STATEMENTS = {
    "CREATE": r"\bCREATE\s+(?:TABLE|INDEX|VIEW|DATABASE)",
    "ALTER": r"\bALTER\s+(?:TABLE|DATABASE)",
    "DROP": r"\bDROP\s+(?:TABLE|INDEX|VIEW|DATABASE)",
    "INSERT": r"\bINSERT\s+INTO",
    "UPDATE": r"\bUPDATE\s+",
    "DELETE": r"\bDELETE\s+FROM",
    "SELECT": r"\bSELECT\s+",
    "TRUNCATE": r"\bTRUNCATE\s+TABLE",
}

DJANGO_OPERATIONS = ["CreateModel", "DeleteModel", "AddField", "RemoveField", "AlterField"]
ALEMBIC_OPERATIONS = ["create_table", "drop_table", "add_column", "drop_column", "alter_column"]

# --- ledgers and requests ----------------------------------------------------------

SUGGESTION_STATUSES = ["pending", "approved", "rejected", "executed", "failed"]
STRATEGIES = ["auto", "split", "extract", "composition"]
PROVIDERS = ["openai", "anthropic", "google", "local"]
PARSERS = ["ast", "tree-sitter", "regex"]
OPERATIONS = ["split_file", "extract_function", "apply_diff", "rename_symbol", "inline_function"]

NO_SUMMARY = "No summary available"

# --- configuration rules: key, low (exclusive unless noted), high ------------------

CONFIG_RANGES = {
    "thresholds.maxLines": (1, 10000),
    "thresholds.maxFunctions": (1, 500),
    "thresholds.maxComplexity": (1, 100),
    "thresholds.maxClassSize": (1, 5000),
    "thresholds.maxMethodLength": (1, 1000),
    "safety.maxFilesPerOperation": (1, 100),
    "ai.maxTokens": (1, 32000),
    "ai.temperature": (0, 2),
}

CONFIG_SECTIONS = ["thresholds", "safety", "ai", "languages", "refactoringStrategies"]

CONFIG_FLAGS = [
    "refactoringStrategies.preferComposition",
    "refactoringStrategies.extractUtilities",
    "refactoringStrategies.maintainNamespaces",
    "refactoringStrategies.preserveComments",
    "refactoringStrategies.updateImports",
    "safety.requireTests",
    "safety.createBackups",
    "safety.dryRunFirst",
    "safety.requireApproval",
]

CONFIG_FREE_KEYS = [
    "name",
    "excludePatterns",
    "refactoringStrategies.preferComposition",
    "refactoringStrategies.extractUtilities",
    "refactoringStrategies.maintainNamespaces",
    "refactoringStrategies.preserveComments",
    "refactoringStrategies.updateImports",
    "safety.requireTests",
    "safety.createBackups",
    "safety.dryRunFirst",
    "safety.requireApproval",
    "ai.model",
]

# --- prompt texts ------------------------------------------------------------------

STRATEGY_TEXT = {
    "auto": "Read the code and automatically determine the best refactoring approach, "
    "whether that is splitting, extraction or better composition.",
    "split": "Concentrate on identifying large functions or classes and on dividing them into focused units.",
    "extract": "Concentrate on reusable code patterns that deserve a function or module of their own.",
    "composition": "Concentrate on object composition and on a looser dependency structure.",
}
