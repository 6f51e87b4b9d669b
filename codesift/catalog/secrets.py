"""Secret and personal-data patterns, sensitive file names, line markers."""

from __future__ import annotations

# Fixed values: (category, pattern, hints); pattern text must stay as published.
# ``hints`` is ours, see patterns.py.
SECRET_ROWS = [
    ("api_key", r"(?i)([a-z0-9_-]+)?api[_-]?key[a-z0-9_-]*[\s]*[=:][^;,)]+", "api"),
    ("api_key", r"(?i)([a-z0-9_-]+)?secret[_-]?key[a-z0-9_-]*[\s]*[=:][^;,)]+", "secret"),
    ("api_key", r"(?i)([a-z0-9_-]+)?auth[_-]?token[a-z0-9_-]*[\s]*[=:][^;,)]+", "auth"),
    ("api_key", r"(?i)([a-z0-9_-]+)?access[_-]?token[a-z0-9_-]*[\s]*[=:][^;,)]+", "access"),
    ("credentials", r"(?i)([a-z0-9_-]+)?password[a-z0-9_-]*[\s]*[=:][^;,)]+", "password"),
    ("credentials", r"(?i)([a-z0-9_-]+)?passwd[a-z0-9_-]*[\s]*[=:][^;,)]+", "passwd"),
    ("credentials", r"(?i)([a-z0-9_-]+)?credential[a-z0-9_-]*[\s]*[=:][^;,)]+", "credential"),
    ("credentials", r"(?i)([a-z0-9_-]+)?secret[a-z0-9_-]*[\s]*[=:][^;,)]+", "secret"),
    ("pii", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "@"),
    ("pii", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", ""),
    ("pii", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", ""),
    ("pii", r"\b(?:\d[ -]*?){13,16}\b", ""),
    ("certificates", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----", "-----begin"),
    ("certificates", r"-----BEGIN CERTIFICATE-----", "-----begin"),
    ("oauth", r"(?i)oauth[_-]?token[a-z0-9_-]*[\s]*[=:][^;,)]+", "oauth"),
    ("oauth", r"(?i)oauth[_-]?secret[a-z0-9_-]*[\s]*[=:][^;,)]+", "oauth"),
    ("aws", r"(?i)aws[_-]?access[_-]?key[_-]?id[a-z0-9_-]*[\s]*[=:][^;,)]+", "aws"),
    ("aws", r"(?i)aws[_-]?secret[_-]?access[_-]?key[a-z0-9_-]*[\s]*[=:][^;,)]+", "aws"),
    ("aws", r"(?i)aws[_-]?account[_-]?id[a-z0-9_-]*[\s]*[=:][^;,)]+", "aws"),
    ("database", r"(?i)(?:mongodb|postgres|mysql|oracle|db2)[_-]?uri[a-z0-9_-]*[\s]*[=:][^;,)]+", "uri"),
    ("database", r"(?i)(?:mongo|postgres|mysql|oracle|db2)[_-]?url[a-z0-9_-]*[\s]*[=:][^;,)]+", "url"),
    ("database", r"(?i)(?:mongo|postgres|mysql|oracle|db2)[_-]?connection[_-]?string[a-z0-9_-]*[\s]*[=:][^;,)]+", "connection"),
    ("jwt", r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "eyj"),
]

# File names that tend to hold secrets (tested without case).
SENSITIVE_FILE_PATTERNS = [
    r"\.env$",
    r"config\.(?:json|yml|yaml|xml|properties|ini|cfg|conf)$",
    r"secrets\.(?:json|yml|yaml|xml|properties|ini|cfg|conf)$",
    r"credentials\.(?:json|yml|yaml|xml|properties|ini|cfg|conf)$",
    r"\.pem$",
    r"\.key$",
    r"\.cert$",
    r"\.pfx$",
    r"\.p12$",
]

# Markers that make the line of a match a likely false positive.
FALSE_POSITIVE_PATTERNS = [
    r"^\s*#", r"^\s*//", r"^\s*/\*", r"\*/",
    r"TEST", r"test", r"Test", r"Mock", r"mock",
    r"example", r"Example", r"EXAMPLE",
    r"sample", r"Sample", r"SAMPLE",
    r"dummy", r"Dummy", r"DUMMY",
    r"(?:None|null|undefined|false)",
]

# Category to severity.
HIGH_CATEGORIES = ["certificates", "api_key", "credentials", "aws"]
MEDIUM_CATEGORIES = ["pii", "oauth", "database", "jwt"]

# Key words of ``.env`` files and their confidence levels.
ENV_KEY_PATTERNS = [
    r"password", r"secret", r"token", r"key", r"auth", r"credentials?",
    r"api[-_]?key", r"access[-_]?token", r"jwt", r"hash", r"encrypt",
]
ENV_HIGH_WORDS = ["password", "secret", "token", "api_key", "apikey"]
ENV_MEDIUM_WORDS = ["key", "auth", "credential", "access"]

# Fixed value: declared entropy threshold in bits per character.
ENTROPY_THRESHOLD = 4.5
