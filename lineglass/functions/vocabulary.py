"""Fixed values of the review: languages, ignored names, severities, limits."""

# File extension -> language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rb": "ruby",
    ".php": "php",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".rs": "rust",
    ".swift": "swift",
    ".kt": "kotlin",
    ".sql": "sql",
    ".sh": "shell",
}

# Directory names that are never entered.
IGNORED_DIRS = [
    "__pycache__", "node_modules", ".git", ".svn", "venv", "env",
    ".venv", ".env", "dist", "build", ".idea", ".vscode", "coverage",
    ".pytest_cache", ".mypy_cache", "egg-info", ".tox", ".nox", ".next",
]

# File names that are never reviewed.
IGNORED_FILES = [
    ".gitignore", ".dockerignore", "package-lock.json", "yarn.lock",
    "poetry.lock", "Pipfile.lock", ".DS_Store",
]

# Severities in report order, with their report markers.
SEVERITIES = ["critical", "error", "warning", "info"]
SEVERITY_MARKERS = {"critical": "🔴", "error": "🟠", "warning": "🟡", "info": "🔵"}

# Default answer model per provider.
DEFAULT_MODELS = {
    "openai": "gpt-4o-mini",
    "anthropic": "claude-3-haiku-20240307",
    "ollama": "llama3",
}

# Limits and thresholds.
MAX_LINE_LENGTH = 120
MAX_FUNCTION_COMPLEXITY = 10
MAX_FUNCTION_ARGUMENTS = 7
TOP_CRITICAL = 30
TOP_WARNINGS = 20
TOP_FILES = 15
FILE_NAME_WIDTH = 30
LISTING_MESSAGE_WIDTH = 80
PROMPT_CODE_LIMIT = 12000
ANSWER_TOKEN_LIMIT = 1500
SUMMARY_LIMIT = 500
SUGGESTION_LIMIT = 10
SUMMARY_LINE_LIMIT = 200

# Substrings counted as decision points in JavaScript/TypeScript.
JS_DECISION_MARKERS = ["if ", "else ", "for ", "while ", "case ", "catch ", "&&", "||", "?"]

REDACTED = "[REDACTED]"
