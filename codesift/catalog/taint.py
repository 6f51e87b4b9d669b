"""Sources, sinks, sanitizers and advice for data flow."""

from __future__ import annotations

# Call name to kind of untrusted data.
TAINT_SOURCES = {
    "request.form": "user_input",
    "request.args": "user_input",
    "request.cookies": "user_input",
    "request.headers": "user_input",
    "request.data": "user_input",
    "request.json": "user_input",
    "input(": "user_input",
    "sys.argv": "command_line",
    "os.environ": "environment",
    "open(": "file_io",
    "sqlite3.connect": "database",
    "mysql.connector.connect": "database",
    "psycopg2.connect": "database",
    "urllib.request.urlopen": "network",
    "requests.get": "network",
    "requests.post": "network",
}

# Call name to (weakness, severity).
TAINT_SINKS = {
    "eval(": ("code_execution", "High"),
    "exec(": ("code_execution", "High"),
    "os.system": ("command_injection", "High"),
    "subprocess.call": ("command_injection", "High"),
    "subprocess.Popen": ("command_injection", "High"),
    "execute": ("sql_injection", "High"),
    "executemany": ("sql_injection", "High"),
    "cursor.execute": ("sql_injection", "High"),
    "render_template_string": ("template_injection", "High"),
    "render": ("xss", "Medium"),
    "response.write": ("xss", "Medium"),
    "open(": ("path_traversal", "Medium"),
    "pickle.loads": ("deserialization", "High"),
    "yaml.load": ("deserialization", "High"),
    "urllib.request.urlopen": ("ssrf", "Medium"),
    "requests.get": ("ssrf", "Medium"),
    "requests.post": ("ssrf", "Medium"),
}

# Words on the sink's line that clear it.
SANITIZERS = [
    "escape", "sanitize", "html.escape", "markupsafe.escape",
    "quote", "quote_plus", "shlex.quote", "parameterized",
    "prepared", "bindparam", "safe_string", "validator",
]

# Advice per weakness, and the text used for all others.
MITIGATIONS = {
    "sql_injection": "Use parameterized queries or an ORM instead of string concatenation.",
    "command_injection": "Use library functions instead of shell commands. If shell commands are necessary, use shlex.quote() to sanitize inputs.",
    "code_execution": "Avoid using eval() or exec() with untrusted input. Use safer alternatives like ast.literal_eval() for parsing.",
    "xss": "Use context-aware escaping and a template system with automatic escaping.",
    "path_traversal": "Use os.path.normpath() and validate paths against a whitelist of allowed directories.",
    "deserialization": "Use safe deserializers like json or yaml.safe_load() instead of pickle or yaml.load().",
    "ssrf": "Validate and sanitize URLs against an allowlist. Do not allow requests to internal resources.",
}
DEFAULT_MITIGATION = "Review and sanitize untrusted inputs before use."
