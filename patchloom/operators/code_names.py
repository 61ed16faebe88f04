"""Names that are built into languages; they are never looked up in a project."""

from __future__ import annotations

import builtins
import sys

# Built-in names by language.
JAVASCRIPT = (
    "console", "window", "document", "process", "global", "globalThis", "undefined", "NaN", "Infinity", "null", "true", "false", "Object", "Array", "String", "Number",
    "Boolean", "Symbol", "BigInt", "Map", "Set", "WeakMap", "WeakSet", "Promise", "Proxy", "Reflect", "RegExp", "Date", "Error", "TypeError", "RangeError",
    "ReferenceError", "SyntaxError", "URIError", "EvalError", "JSON", "Math", "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURI", "decodeURI",
    "encodeURIComponent", "decodeURIComponent", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "require", "module", "exports", "__dirname", "__filename",
    "Buffer", "fetch", "URL", "URLSearchParams", "TextEncoder", "TextDecoder", "AbortController", "AbortSignal", "FormData", "Headers", "Request", "Response", "Event",
    "EventTarget", "ReadableStream", "WritableStream", "TransformStream", "Blob", "File", "FileReader", "queueMicrotask", "structuredClone", "atob", "btoa",
)
TYPESCRIPT_MORE = (
    "unknown", "never", "void", "any", "Readonly", "Partial", "Required", "Pick", "Omit", "Record", "Exclude", "Extract", "NonNullable", "ReturnType", "Parameters",
    "ConstructorParameters", "InstanceType", "ThisType", "Awaited", "keyof", "typeof", "infer",
)
JAVA = (
    "Object", "String", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Short", "Character", "Void", "Number", "Math", "System", "Class", "Thread", "Runnable",
    "StringBuilder", "StringBuffer", "Throwable", "Exception", "RuntimeException", "Error", "NullPointerException", "IllegalArgumentException", "IllegalStateException",
    "UnsupportedOperationException", "IndexOutOfBoundsException", "ClassCastException", "ArrayIndexOutOfBoundsException", "StackOverflowError", "OutOfMemoryError",
    "Override", "Deprecated", "SuppressWarnings", "FunctionalInterface", "Iterable", "Comparable", "Cloneable", "AutoCloseable", "Enum", "Record", "ProcessBuilder",
    "this", "super", "null", "true", "false", "var",
)
GO = (
    "append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover", "bool",
    "byte", "comparable", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32", "int64", "rune", "string", "uint", "uint8",
    "uint16", "uint32", "uint64", "uintptr", "any", "true", "false", "nil", "iota",
)
RUBY = (
    "puts", "print", "p", "pp", "warn", "raise", "fail", "require", "require_relative", "load", "autoload", "open", "gets", "sleep", "exit", "abort", "at_exit", "rand",
    "srand", "sprintf", "format", "loop", "lambda", "proc", "block_given?", "caller", "catch", "throw", "binding", "eval", "Object", "Class", "Module", "Kernel",
    "BasicObject", "String", "Integer", "Float", "Symbol", "Array", "Hash", "Range", "Regexp", "Proc", "Method", "IO", "File", "Dir", "Time", "Date", "DateTime",
    "Struct", "OpenStruct", "Comparable", "Enumerable", "Enumerator", "Encoding", "Thread", "Mutex", "Fiber", "NilClass", "TrueClass", "FalseClass", "Numeric",
    "Complex", "Rational", "BigDecimal", "Set", "Math", "Errno", "ENV", "ARGV", "STDIN", "STDOUT", "STDERR", "Exception", "StandardError", "RuntimeError", "TypeError",
    "ArgumentError", "NameError", "NoMethodError", "IOError", "SystemExit", "SignalException", "Interrupt", "LoadError", "NotImplementedError", "RangeError",
    "ZeroDivisionError", "IndexError", "KeyError", "StopIteration", "RegexpError", "ScriptError", "SyntaxError", "SecurityError", "SystemCallError", "SystemStackError",
    "EOFError", "self", "super", "nil", "true", "false", "__FILE__", "__LINE__", "__dir__", "__method__",
)
PHP = (
    "array_map", "array_filter", "array_reduce", "array_merge", "array_push", "array_pop", "array_keys", "array_values", "array_unique", "array_reverse", "array_slice",
    "array_search", "array_walk", "in_array", "count", "sizeof", "sort", "usort", "ksort", "array_combine", "array_diff", "array_intersect", "compact", "extract",
    "strlen", "strpos", "substr", "str_replace", "strtolower", "strtoupper", "trim", "ltrim", "rtrim", "explode", "implode", "sprintf", "printf", "number_format",
    "str_contains", "str_starts_with", "str_ends_with", "preg_match", "preg_replace", "preg_split", "isset", "unset", "empty", "is_null", "is_string", "is_int",
    "is_float", "is_bool", "is_array", "is_object", "is_numeric", "is_callable", "gettype", "intval", "floatval", "strval", "boolval", "echo", "print", "var_dump",
    "print_r", "var_export", "json_encode", "json_decode", "file_get_contents", "file_put_contents", "file_exists", "is_file", "is_dir", "abs", "ceil", "floor", "round",
    "max", "min", "rand", "mt_rand", "pow", "date", "time", "mktime", "strtotime", "md5", "sha1", "hash", "password_hash", "password_verify", "base64_encode",
    "base64_decode", "urlencode", "urldecode", "htmlspecialchars", "htmlentities", "html_entity_decode", "class_exists", "function_exists", "method_exists",
    "property_exists", "get_class", "get_object_vars", "die", "exit", "header", "setcookie", "defined", "define", "constant", "null", "true", "false", "self", "static",
    "parent", "this", "__DIR__", "__FILE__", "__LINE__", "__CLASS__", "__FUNCTION__", "__METHOD__", "__NAMESPACE__",
)
ELIXIR = (
    "Kernel", "Enum", "Map", "List", "String", "IO", "File", "Path", "Agent", "GenServer", "Supervisor", "Task", "Logger", "Process", "Tuple", "Keyword", "MapSet",
    "Range", "Stream", "Regex", "Integer", "Float", "Atom", "Port", "System", "Code", "Macro", "Module", "Access", "Date", "DateTime", "Time", "NaiveDateTime",
    "Calendar", "URI", "Base", "Bitwise", "Exception", "Protocol", "Inspect", "Collectable", "Enumerable", "Application", "Config", "Mix", "ExUnit", ":erlang", ":ets",
    ":crypto", ":timer", ":gen_server", ":supervisor",
)
# Modules of Ruby's standard library, and the first parts of Java's packages.
RUBY_MODULES = (
    "abbrev", "base64", "benchmark", "bigdecimal", "cgi", "csv", "date", "delegate", "digest", "drb", "erb", "etc", "fcntl", "fiddle", "fileutils", "find",
    "forwardable", "io/console", "io/nonblock", "io/wait", "ipaddr", "irb", "json", "logger", "matrix", "minitest", "monitor", "mutex_m", "net/ftp", "net/http",
    "net/imap", "net/pop", "net/smtp", "nkf", "observer", "open-uri", "open3", "openssl", "optparse", "ostruct", "pathname", "pp", "prettyprint", "prime", "pstore",
    "psych", "racc", "rdoc", "readline", "reline", "resolv", "ripper", "rss", "securerandom", "set", "shellwords", "singleton", "socket", "stringio", "strscan",
    "syslog", "tempfile", "time", "timeout", "tmpdir", "tsort", "un", "uri", "weakref", "webrick", "yaml", "zlib",
)
JAVA_PREFIXES = ("java.", "javax.", "jdk.", "com.sun.", "sun.", "org.w3c.", "org.xml.", "org.omg.")


def names(language: str) -> frozenset[str]:
    """Built-in names of a language; Python's are those of the interpreter."""
    if language == "python":
        return frozenset(dir(builtins))
    if language == "typescript":
        return frozenset((*JAVASCRIPT, *TYPESCRIPT_MORE))
    known = {"javascript": JAVASCRIPT, "java": JAVA, "go": GO, "ruby": RUBY, "php": PHP, "elixir": ELIXIR}
    return frozenset(known.get(language, ()))


def python_modules() -> frozenset[str]:
    """Modules of Python's standard library, as the interpreter lists them."""
    return frozenset(sys.stdlib_module_names)
