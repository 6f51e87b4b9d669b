"""Severity levels per type and the words that raise or lower them."""

from __future__ import annotations

# Finding type to usual level; any other type is Medium.
BASE_SEVERITY = {
    "Command Execution": "High",
    "SQL Injection": "High",
    "XSS": "Medium",
    "Path Traversal": "Medium",
    "Deserialization": "High",
    "Buffer Overflow": "High",
    "Format String": "Medium",
    "Authentication Flaw": "High",
    "Cryptographic Flaw": "Medium",
    "Hard-coded Credentials": "High",
    "Insecure Randomness": "Medium",
    "User Input": "Low",
    "Information Disclosure": "Medium",
    "Race Condition": "Medium",
    "Integer Overflow": "Medium",
    "Unchecked Return Value": "Low",
    "Unvalidated Redirect": "Medium",
    "CSRF": "Medium",
    "Logic Bug": "Medium",
    "Default Credentials": "High",
    "Syntax Error": "Low",
    "Memory Leak": "Low",
}

# Words in the code line, in the order they are reported.
HIGH_RISK_WORDS = [
    "password", "token", "secret", "credential", "auth", "admin",
    "root", "sudo", "shell", "exec", "system", "run", "popen", "eval",
    "command", "api_key", "apikey", "execute", "database", "db", "sql",
    "query", "delete", "drop", "insert", "update", "select",
]
LOW_RISK_WORDS = [
    "comment", "log", "print", "echo", "debug", "test", "example",
    "sample", "mock", "dummy", "stub", "template", "placeholder",
]
HARD_CODED_WORDS = ["password", "api_key", "secret", "token"]

# Sentences of the explanation.
HIGH_RISK_TEXT = "Contains high-risk keyword '{}'"
LOW_RISK_TEXT = "Contains low-risk context keyword '{}'"
DYNAMIC_COMMAND_TEXT = "Command includes dynamic content (higher risk of injection)"
VALIDATED_COMMAND_TEXT = "Contains validation/sanitization attempt"
PARAMETERIZED_SQL_TEXT = "May be using parameterized queries"
CONCATENATED_SQL_TEXT = "Direct string concatenation in SQL query"
ENCODED_OUTPUT_TEXT = "Contains output encoding/sanitization"
HARD_CODED_TEXT = "Contains hard-coded {}"
