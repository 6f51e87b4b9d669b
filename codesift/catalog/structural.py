"""Structural rules: conditions on code facts rather than on text."""

from __future__ import annotations


def _calls(*names: str) -> list[dict]:
    return [{"type": "function_call", "name": n} for n in names]


# Fixed values: (language, id, name, description, severity, patterns, mitigation).
STRUCTURAL_RULE_ROWS = [
    ("python", "PY-EVAL-EXEC-001", "Use of eval() or exec()",
     "Identifies potentially dangerous use of eval() or exec()", "High",
     _calls("eval", "exec"),
     "Avoid using eval() or exec() with user input. Use safer alternatives like ast.literal_eval() for limited parsing."),
    ("python", "PY-SQL-INJECTION-001", "Potential SQL Injection",
     "String formatting used in SQL queries", "High",
     [{"type": "function_call", "name": "execute", "with_string_formatting": True}],
     "Use parameterized queries or ORM instead of string formatting."),
    ("python", "PY-CMD-INJECTION-001", "Command Injection",
     "Shell command execution with potential for command injection", "High",
     _calls("os.system", "subprocess.call", "subprocess.Popen", "os.popen"),
     "Use library functions instead of shell commands. If shell commands are necessary, use shlex.quote() to sanitize inputs."),
    ("python", "PY-PICKLE-001", "Unsafe Deserialization",
     "Use of pickle or marshall with untrusted data", "High",
     _calls("pickle.loads", "pickle.load", "marshal.loads", "marshal.load"),
     "Use safer serialization formats like JSON for untrusted data."),
    ("python", "PY-YAML-LOAD-001", "Unsafe YAML Loading",
     "Use of yaml.load() without safe loading", "High",
     _calls("yaml.load"),
     "Use yaml.safe_load() instead of yaml.load() for untrusted YAML data."),
    ("python", "PY-PATH-TRAVERSAL-001", "Path Traversal",
     "File operations without path sanitization", "Medium",
     _calls("open"),
     "Use os.path.normpath() and validate paths against a whitelist of allowed directories."),
    ("python", "PY-WEAK-CRYPTO-001", "Weak Cryptography",
     "Use of weak cryptographic algorithms", "Medium",
     [{"type": "import", "name": "md5"}, *_calls("hashlib.md5", "hashlib.sha1"),
      {"type": "import", "name": "Crypto.Cipher.DES"}],
     "Use strong cryptographic algorithms like SHA-256 or higher, and use established libraries for encryption."),
    ("python", "PY-HARDCODED-SECRET-001", "Hardcoded Secret",
     "Potential hardcoded credentials or API keys", "High",
     [{"type": "assignment", "variable_name": v} for v in ("password", "api_key", "secret", "token")],
     "Store secrets in environment variables or a secure secret management system."),
    ("python", "PY-INSECURE-RANDOM-001", "Insecure Randomness",
     "Use of insecure random number generation", "Medium",
     [{"type": "import", "name": "random"}, *_calls("random.random", "random.randint")],
     "Use secrets module or cryptographically secure random number generators for security purposes."),
    ("python", "PY-BARE-EXCEPT-001", "Bare Except Clause",
     "Use of bare except clause", "Low",
     [{"type": "exception_handling", "pattern": "except:"}],
     "Specify the exception types to catch, e.g., 'except Exception:' or more specific types."),
    ("javascript", "JS-EVAL-001", "Use of eval()",
     "Identifies potentially dangerous use of eval()", "High",
     _calls("eval"),
     "Avoid using eval() with user input. Use alternatives like JSON.parse() for JSON data."),
    ("javascript", "JS-EXEC-SQL-001", "SQL Injection in JS",
     "String concatenation used in SQL queries", "High",
     [{"type": "string_concat", "with": "SQL"}],
     "Use parameterized queries or ORM instead of string concatenation."),
    ("javascript", "JS-XSS-001", "Cross-Site Scripting",
     "Potential XSS vulnerabilities", "High",
     [{"type": "assignment", "target": "innerHTML"}, {"type": "assignment", "target": "outerHTML"},
      *_calls("document.write")],
     "Use textContent instead of innerHTML where possible, or use a library that automatically escapes HTML."),
    ("javascript", "JS-PROTO-POLLUTION-001", "Prototype Pollution",
     "Operations that could lead to prototype pollution", "High",
     [{"type": "assignment", "target": "__proto__"}, {"type": "assignment", "target": "prototype"},
      {"type": "object_merge"}],
     "Use Object.create(null) for dictionaries, use object-freeze, or validate keys to prevent __proto__ and constructor."),
    ("javascript", "JS-NOSQL-INJECTION-001", "NoSQL Injection",
     "Potential NoSQL injection in MongoDB queries", "High",
     _calls("findOne", "find"),
     "Validate and sanitize inputs, and use query operators with fixed keys."),
]

# Pattern types that have a defined meaning here; rows of any other type are
# kept in the table and reported as skipped.
APPLIED_PATTERN_TYPES = ["function_call", "import", "assignment", "exception_handling"]

# Exact call names to the type they report.
DANGEROUS_CALLS = {
    "exec": "Command Execution",
    "eval": "Command Execution",
    "os.system": "Command Execution",
    "os.popen": "Command Execution",
    "subprocess.call": "Command Execution",
    "subprocess.Popen": "Command Execution",
    "pickle.loads": "Deserialization",
    "yaml.load": "Deserialization",
    "sqlite3.connect": "SQL Injection (SQLite)",
    "mysql.connector.connect": "SQL Injection (MySQL)",
    "psycopg2.connect": "SQL Injection (PostgreSQL)",
    "pymongo.MongoClient": "NoSQL Injection",
}

# Names looked for when a snippet defines no function, in order.
GRAPH_DANGEROUS_NAMES = [
    "eval", "exec", "system", "os.popen", "os.system", "subprocess.call",
    "subprocess.Popen", "input", "pickle.loads", "execute", "query",
    "innerHTML", "document.write", "mysql_query",
]
