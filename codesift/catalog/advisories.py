"""Advisories on published package versions, and manifest names."""

from __future__ import annotations

_NVD = "https://nvd.nist.gov/vuln/detail/"

# Fixed values: (id, language, package, affected, patched, severity, title,
# description, published).
ADVISORY_ROWS = [
    ("CVE-2018-18074", "python", "requests", ["<=2.19.1"], [">=2.20.0"], "High",
     "CRLF injection vulnerability in Requests",
     "The Requests package before 2.20.0 for Python sends an HTTP Authorization header to an http URI upon redirects.",
     "2018-10-15"),
    ("CVE-2019-11324", "python", "urllib3", ["<1.24.2"], [">=1.24.2"], "High",
     "CRLF injection in urllib3",
     "In urllib3 before 1.24.2, CRLF injection is possible if the attacker controls the request parameters.",
     "2019-04-13"),
    ("CVE-2021-23727", "python", "jinja2", ["<2.11.3"], [">=2.11.3"], "Medium",
     "Regular Expression Denial of Service in Jinja2",
     "This affects the package jinja2 from 0.0.0 and before 2.11.3. The ReDoS vulnerability is mainly due to the `_punctuation_re regex` operator that is vulnerable to ReDoS attacks.",
     "2021-03-07"),
    ("CVE-2019-11358", "javascript", "jquery", ["<3.4.0"], [">=3.4.0"], "Medium",
     "Prototype Pollution in jQuery",
     "jQuery before 3.4.0 mishandles jQuery.extend(true, {}, ...) because of Object.prototype pollution.",
     "2019-04-20"),
    ("CVE-2021-23337", "javascript", "lodash", ["<4.17.21"], [">=4.17.21"], "High",
     "Command Injection in Lodash",
     "Lodash versions prior to 4.17.21 are vulnerable to Command Injection via the template function.",
     "2021-02-15"),
    ("CVE-2021-44228", "java", "org.apache.logging.log4j:log4j-core", [">=2.0.0", "<=2.14.1"], [">=2.15.0"], "Critical",
     "Log4Shell Vulnerability in Log4j",
     "Apache Log4j2 <=2.14.1 JNDI features used in configuration, log messages, and parameters do not protect against attacker-controlled LDAP and other JNDI related endpoints.",
     "2021-12-10"),
    ("CVE-2019-10910", "php", "symfony/security-http", ["<4.2.12", "<4.3.8"], [">=4.2.12", ">=4.3.8"], "Medium",
     "Symfony Security Session Fixation",
     "In Symfony before 4.2.12 and 4.3.x before 4.3.8, a session fixation issue exists when using the remember me functionality.",
     "2019-10-09"),
    ("CVE-2020-1108", "dotnet", "Newtonsoft.Json", ["<12.0.3"], [">=12.0.3"], "Medium",
     "JSON.NET Denial of Service",
     "A denial of service vulnerability exists in Newtonsoft.Json before 12.0.3 when processing deeply nested JSON.",
     "2020-04-14"),
    ("CVE-2020-36067", "go", "github.com/gin-gonic/gin", ["<1.6.0"], [">=1.6.0"], "Medium",
     "Gin Path Traversal",
     "A path traversal issue exists in Gin before 1.6.0 that allows attackers to read files outside the server root directory.",
     "2020-01-21"),
    ("CVE-2020-8165", "ruby", "activesupport", ["<5.2.5", "<6.0.4"], [">=5.2.5", ">=6.0.4"], "Critical",
     "Rails ActiveSupport Remote Code Execution",
     "A deserialization of untrusted data vulnerability exists in Rails ActiveSupport before 5.2.5 and 6.0.x before 6.0.4 that can allow an attacker to execute arbitrary code.",
     "2020-05-18"),
]


def reference_link(advisory_id: str) -> str:
    return _NVD + advisory_id


# Manifest file names per language; ``*`` marks a suffix.
MANIFEST_NAMES = {
    "python": ["requirements.txt", "Pipfile", "Pipfile.lock", "setup.py", "pyproject.toml"],
    "javascript": ["package.json", "package-lock.json", "yarn.lock", "npm-shrinkwrap.json"],
    "php": ["composer.json", "composer.lock"],
    "ruby": ["Gemfile", "Gemfile.lock"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "dotnet": ["*.csproj", "packages.config", "project.json"],
    "go": ["go.mod", "go.sum", "Gopkg.lock", "Gopkg.toml"],
}
