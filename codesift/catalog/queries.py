"""Built-in saved queries."""

from __future__ import annotations

# Fixed values: (id, name, description, language, type, pattern, severity, tags).
SAVED_QUERY_ROWS = [
    ("py-eval-exec", "Dangerous Use of eval() or exec()",
     "Detects potentially dangerous uses of eval() or exec() in Python code",
     "python", "regex", r"(eval|exec)\s*\((.+?)\)", "High", ["security", "injection"]),
    ("sql-injection", "SQL Injection Vulnerability",
     "Detects potential SQL injection vulnerabilities in Python code",
     "python", "regex", r"execute\s*\(\s*[\"']SELECT|UPDATE|INSERT|DELETE.+?%|format|f[\"']", "High",
     ["security", "injection", "sql"]),
    ("hardcoded-secrets", "Hardcoded Secrets",
     "Detects hardcoded API keys, tokens, or passwords in code",
     "common", "regex", r"(?:api_key|apikey|token|secret|password|pwd|auth)\s*=\s*['\"]([a-zA-Z0-9_\-\.]{16,})['\"]", "High",
     ["security", "secrets"]),
    ("py-os-command-injection", "OS Command Injection in Python",
     "Detects potential OS command injection vulnerabilities in Python code",
     "python", "regex", r"os\.(system|popen|spawn|exec)|subprocess\.(call|run|Popen|check_output|check_call)", "High",
     ["security", "injection", "command"]),
    ("insecure-deserialization", "Insecure Deserialization",
     "Detects insecure deserialization that might lead to remote code execution",
     "python", "regex", r"(pickle|cPickle|marshal|yaml)\.(loads?|unsafe_loads?)", "High",
     ["security", "deserialization"]),
    ("weak-crypto", "Weak Cryptography",
     "Detects uses of weak cryptographic algorithms or modes",
     "python", "regex", r"(md5|sha1|DES|RC4)", "Medium", ["security", "crypto"]),
    ("xxe-vulnerability", "XML External Entity (XXE) Vulnerability",
     "Detects potential XXE vulnerabilities in XML parsing",
     "python", "regex", r"(xml\.etree\.ElementTree|xml\.dom\.minidom|lxml\.etree)\.parse\([^,]*\)", "High",
     ["security", "xxe"]),
    ("cors-misconfiguration", "CORS Misconfiguration",
     "Detects potential CORS misconfigurations that allow unintended cross-origin access",
     "python", "regex", r"(Access-Control-Allow-Origin).*[*]", "Medium", ["security", "cors"]),
    ("directory-traversal", "Directory Traversal",
     "Detects code patterns that might allow directory traversal attacks",
     "python", "regex", r"open\s*\(\s*[^,)]+\s*\+", "High", ["security", "file-access"]),
    ("ssrf-vulnerability", "Server-Side Request Forgery (SSRF)",
     "Detects code patterns that might allow SSRF attacks",
     "python", "regex", r"(urllib\.request\.urlopen|requests\.(get|post|put|delete))\s*\(\s*[^,)]*\)", "High",
     ["security", "ssrf"]),
]

# Fixed value: text searched by the one structural query (``dangerous_eval``).
DANGEROUS_EVAL_PATTERN = r"eval\s*\((.+?)\)"
