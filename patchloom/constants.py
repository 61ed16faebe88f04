"""Fixed values of the review rules. They decide results, so they are stated as they are, in their natural order."""

from __future__ import annotations

# Severities and confidences, worst and surest first; what a severity does by default.
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
CONFIDENCES = ("High", "Medium", "Low")
DEFAULT_ACTIONS = {"Critical": "block", "High": "block", "Medium": "warn", "Low": "allow", "Info": "allow"}

# Language by file name.
LANGUAGE_BY_COMPOUND_SUFFIX = {".blade.php": "html"}
LANGUAGE_BY_SUFFIX = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescript",
    ".java": "java", ".rb": "ruby", ".go": "go", ".php": "php", ".ex": "elixir", ".exs": "elixir",
    ".vue": "vue", ".svelte": "svelte", ".astro": "astro",
    ".html": "html", ".htm": "html", ".ejs": "html", ".hbs": "html", ".handlebars": "html", ".njk": "html", ".nunjucks": "html", ".pug": "html",
    ".erb": "html", ".heex": "html", ".jinja": "html", ".jinja2": "html", ".mustache": "html",
    ".css": "css", ".scss": "css", ".sass": "css", ".less": "css", ".mk": "makefile",
}
LANGUAGE_BY_NAME = {"Makefile": "makefile", "makefile": "makefile", "GNUmakefile": "makefile"}

# Globs of sensitive files; the first match in this order is the one reported.
SENSITIVE_GLOBS = (
    ".env", ".env.*", "*.env", ".env.*.local",
    "secrets.json", "secrets.yml", "secrets.yaml", "secrets.toml", "credentials.json", "credentials.yml", "credentials.yaml", ".secrets", "*.secrets", "*.secrets.*",
    "*.pem", "*.key", "*.crt", "*.p12", "*.pfx", "*.jks", "*.keystore", "*.jceks",
    "id_rsa", "id_rsa.*", "id_dsa", "id_dsa.*", "id_ecdsa", "id_ecdsa.*", "id_ed25519", "id_ed25519.*", "*.gpg", "*.asc",
    "application-secrets.properties", "application-local.properties", "*-local.properties", "*.local.properties", "env.properties", "secrets.properties", "bootstrap-local.yml", "bootstrap-local.yaml",
    "master.key", "database.yml", "parameters.yml", "parameters.yaml", "*.decrypt.private.php", "config.local.php",
    "local_settings.py", "settings_local.py", "secrets.py", ".pypirc", ".npmrc", "config.local.js", "config.local.json", "config.local.yaml",
    "*.tfvars", "*.tfvars.json", "*.tfstate", "*.tfstate.*", ".terraformrc", "terraform.rc",
    ".aws/credentials", "*-sa-key.json", "*-sa.json", "service-account*.json", "gcloud*.json", ".azure/credentials",
    ".docker/config.json", "docker-compose.override.yml", "*-secret.yaml", "*-secret.yml", ".htpasswd", "*.kdbx", "*.kdb",
    "vault.yml", "vault.yaml", "*.cred", "*.credentials", "authinfo", ".authinfo", ".netrc",
)

# Folders of vendored and built files.
VENDOR_PATTERNS = (
    "venv/", ".venv/", "site-packages/", "staticfiles/", ".tox/", "htmlcov/", "node_modules/", "bower_components/", "target/", "build/", ".gradle/",
    "vendor/bundle/", "vendor/ruby/", ".bundle/", "tmp/cache/", "log/", "vendor/", "storage/framework/",
    "wp-includes/", "wp-admin/", "wp-content/cache/", "wp-content/uploads/", "wp-content/upgrade/", "deps/", "_build/", "priv/static/",
)

# Marks of generated files.
PYTHON_MARKS = ("# Auto-generated", "# auto-generated", "# Generated by", "# DO NOT EDIT", "# This file was generated")
DJANGO_MARK = "# Generated by Django"
MINIFIED_SUFFIXES = (".min.js", ".min.mjs", ".min.cjs", ".bundle.js", ".chunk.js")
DECLARATION_SUFFIXES = (".d.ts", ".d.mts", ".d.cts")
DECLARATION_MARKS = ("// Generated by", "// Auto-generated", "// auto-generated", "/* Generated by", "/* Auto-generated")
JAVA_SEGMENTS = ("generated-sources/", "generated/", "apt_generated/")
JAVA_MARKS = ("@Generated", "@javax.annotation.Generated")
RUBY_MARKS = ("# This file is auto-generated", "# Auto-generated", "# Generated by", "# DO NOT EDIT", "# This file was generated", "# This migration was auto-generated")
GO_SUFFIXES = (".pb.go", "_string.go", "_gen.go", "_mock.go")
GO_HEADER = r"^// Code generated .+ DO NOT EDIT\.$"
PHP_SEGMENTS = ("var/cache/", "bootstrap/cache/", "storage/framework/cache/", "storage/framework/views/")
PHP_MARKS = ("<?php // auto-generated", "<?php // Auto-generated", "// auto-generated", "// Auto-generated", "@generated", "/* auto-generated", "/* Auto-generated")
ELIXIR_MARKS = ("# Generated by", "# DO NOT EDIT", "# This file is auto-generated", "# Auto-generated")
LONG_LINES, HEAD_LINES = 500, 20

# CWE numbers by severity.
CWE_CRITICAL = (
    77, 78, 94, 95, 96, 97, 98, 114, 119, 120, 121, 122, 287, 288, 290, 294, 302, 306, 416, 426, 427, 470, 494, 787, 829, 913, 917, 1336,
)
CWE_HIGH = (
    20, 22, 23, 35, 36, 59, 73, 74, 79, 80, 83, 87, 88, 89, 90, 91, 93, 99, 113, 125, 131, 134, 138, 184, 190, 191, 212, 219, 242, 250, 256, 257, 259, 260, 266, 269,
    276, 284, 285, 295, 297, 304, 307, 311, 312, 319, 321, 325, 327, 328, 345, 347, 415, 428, 434, 476, 502, 522, 523, 538, 540, 547, 552, 564, 599, 610, 611, 643, 652,
    669, 676, 681, 704, 732, 749, 759, 760, 762, 763, 776, 780, 789, 798, 805, 824, 825, 843, 862, 863, 915, 916, 918, 943, 1321, 1390,
)
CWE_MEDIUM = (
    116, 117, 129, 178, 193, 200, 201, 203, 208, 252, 253, 271, 272, 280, 296, 300, 313, 315, 316, 322, 323, 324, 326, 329, 330, 331, 335, 336, 337, 338, 340, 346, 348,
    352, 353, 354, 358, 359, 362, 367, 369, 377, 379, 384, 400, 401, 402, 404, 407, 409, 413, 419, 425, 436, 441, 444, 457, 459, 471, 472, 497, 501, 521, 526, 530, 532,
    548, 565, 566, 598, 601, 613, 614, 620, 639, 640, 644, 651, 662, 665, 667, 668, 670, 672, 674, 682, 697, 706, 757, 764, 770, 772, 775, 784, 821, 833, 838, 908, 909,
    922, 924, 940, 941, 942, 1004, 1021, 1188, 1204, 1216, 1275, 1284, 1327, 1333, 1419,
)
CWE_LOW = (
    2, 11, 13, 15, 16, 75, 76, 155, 180, 182, 183, 185, 209, 235, 243, 244, 430, 466, 467, 469, 477, 489, 520, 537, 541, 554, 562, 573, 587, 588, 606, 617, 684, 685,
    686, 687, 754, 756, 758, 1024, 1077, 1174, 1236, 1335, 1341,
)
CWE_INFO = (
    223, 398, 448, 561, 563, 710, 778, 830, 1061, 1078, 1104, 1116, 1164,
)


def cwe_severities() -> list[tuple[str, str]]:
    """(CWE id, severity) for all mapped weaknesses."""
    lists = zip(SEVERITIES, (CWE_CRITICAL, CWE_HIGH, CWE_MEDIUM, CWE_LOW, CWE_INFO), strict=True)
    return [(f"CWE-{n}", severity) for severity, numbers in lists for n in numbers]
