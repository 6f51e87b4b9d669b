"""Extension, language and path constants."""

from __future__ import annotations

# Supported extensions and their language names.
SUPPORTED_EXTENSIONS = {
    ".py": "Python", ".php": "PHP", ".js": "JavaScript", ".java": "Java",
    ".c": "C", ".cpp": "C++", ".go": "Go", ".rb": "Ruby", ".cs": "C#",
    ".ts": "TypeScript", ".swift": "Swift", ".kt": "Kotlin", ".jsx": "React",
    ".tsx": "React TypeScript", ".html": "HTML", ".xml": "XML", ".sql": "SQL",
}

# Default exclusions, size cap, prefix tested for binary data.
EXCLUDED_DIRS = [".git", "node_modules", "venv", "__pycache__", "dist", "build"]
EXCLUDED_FILES = [".DS_Store", "*.pyc", "*.min.js", "*.min.css"]
MAX_FILE_BYTES = 1024 * 1024
MAX_FILES = 10000
BINARY_PROBE_CHARS = 1024

# Rule and query language names to the extension they apply to.
RULE_LANGUAGE_EXTENSIONS = {"python": ".py", "javascript": ".js"}

SEVERITY_RANKS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
