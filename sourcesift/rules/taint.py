"""Taint sources, sinks and assignments. Ids, kinds and patterns decide the flows."""

from __future__ import annotations

from sourcesift.rules.model import member_then, name_then, span
from sourcesift.rules.surface import spec

SOURCES = [
    spec("location-hash", r"location\.hash\b", ("location.hash",), category="URL"),
    spec("location-search", r"location\.search\b", ("location.search",), category="URL"),
    spec("location-href", r"location\.href\b", ("location.href",), category="URL"),
    spec("location-pathname", r"location\.pathname\b", ("location.pathname",), category="URL"),
    spec("document-url", r"document\.URL\b", ("document.URL",), category="Document"),
    spec("document-referrer", r"document\.referrer\b", ("document.referrer",), category="Document"),
    spec("document-cookie", r"document\.cookie\b", ("document.cookie",), category="Document"),
    spec("window-name", r"window\.name\b", ("window.name",), category="Window"),
    spec("postmessage-data", r"(?:event|e)\.data\b", (".data",), category="PostMessage"),
    spec("localstorage-read", r"localStorage\.getItem\s*\(", ("localStorage.getItem",), category="Storage"),
    spec("sessionstorage-read", r"sessionStorage\.getItem\s*\(", ("sessionStorage.getItem",), category="Storage"),
    spec("url-search-params", r"URLSearchParams[^;]{0,200}\.get\s*\(", ("URLSearchParams",), category="URL"),
    spec("response-body", r"response\.(?:data|body|text)\b", ("response.",), category="HTTP"),
    spec("input-value", r"\.value\s*(?:=|\bin\b)", (".value",), category="DOM"),
    spec("response-json", r"\.json\s*\(", (".json",), category="HTTP"),
    spec("prompt-result", r"prompt\s*\(", ("prompt",), category="UserInput"),
]
SINKS = [
    spec("innerhtml", r"\.innerHTML\s*=", (".innerHTML",), severity="critical", cwe="CWE-79"),
    spec("outerhtml", r"\.outerHTML\s*=", (".outerHTML",), severity="critical", cwe="CWE-79"),
    spec("insertadjhtml", r"\.insertAdjacentHTML\s*\(", (".insertAdjacentHTML",), severity="critical", cwe="CWE-79"),
    spec("documentwrite", r"document\.write\s*\(", ("document.write",), severity="critical", cwe="CWE-79"),
    spec("srcdoc", r"\.srcdoc\s*=", (".srcdoc",), severity="critical", cwe="CWE-79"),
    spec("eval", r"\beval\s*\(", ("eval",), severity="critical", cwe="CWE-95"),
    spec("function-ctor", r"new\s+Function\s*\(", ("Function",), severity="critical", cwe="CWE-95"),
    spec("location-href-assign", r"location\.(?:href|replace|assign)\s*[=(]", ("location.",), severity="high", cwe="CWE-601"),
    spec("setattribute-on", r"""\.setAttribute\s*\(\s*['"]on\w+['"]\s*,""", (".setAttribute",), severity="critical", cwe="CWE-79"),
    spec("jquery-html", span(r"\.html\s*\(", "[^)]", r"\)", least=1), (".html",), severity="critical", cwe="CWE-79"),
    spec("jquery-append", span(r"\.(?:append|prepend|after|before)\s*\(", "[^)]", r"\)", least=1),
         (".append", ".prepend", ".after", ".before"), severity="high", cwe="CWE-79"),
]
STATEMENT = r"[^;{]*$"
DECLARED = r"(?:const|let|var)\s+(\w+)\s*=\s*[^;]*$"
REASSIGNED = r"(\w+)\s*=\s*[^;]*$"
NOT_A_NAME = r"^(?:this|return|if|else|for|while|case|new.*)$"
ASSIGNMENTS = [
    spec("declaration", r"(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*([^;]+)", ("=",), 2),
    spec("reassignment", name_then("[a-zA-Z_$]", "[a-zA-Z0-9_$]", r"\s*=\s*([^;{]+)"), ("=",), 2),
    spec("member", member_then("[A-Za-z_$]", "[A-Za-z0-9_$]", r"\s*=\s*([^;]+)"), ("=",), 2),
]
KEYWORD = r"^(?:this|true|false|null|undefined|if|else|for|while|return)$"
CONDITION = r"^\s*(?:if|while|for)\s*\("
NAME_CHAIN = r"[A-Za-z0-9_$]+(?:\.[A-Za-z0-9_$]+)*"
# the same taken apart: every name of a chain, and every name with the next one as group 1
NAME = r"[A-Za-z0-9_$]+"
NAME_PAIR = r"(?<![A-Za-z0-9_$])(?=([A-Za-z0-9_$]++\.[A-Za-z0-9_$]++))[A-Za-z0-9_$]++\."

# Fallback: where a variable is bound before a source, and properties of function parameters.
FALLBACK_DECLARED = r"(?:const|let|var|private|public|readonly)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*(?::\s*[A-Za-z_$][A-Za-z0-9_$]*)?\s*=\s*$"
FALLBACK_MEMBER = r"this\.([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*$"
FALLBACK_PARAM = r"function\s*(?:<[^>]*>)?\s*\([^)]*\b([A-Za-z_$][A-Za-z0-9_$]*)\b[^)]*\)\s*\{[^}]{0,80}$"
PARAMETERS = r"(?:function|=>)\s*\([^)]*\)"
PARAMETER_PROPERTY = r"\.(?:data|body|message|value|text|response|result|input|param|query)\b"

FUNCTION_STARTS = [
    spec("function", r"\b(?:async\s+)?function\s*\*?\s*(\w*)\s*\(", ("function",), 1),
    spec("arrow", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:\([^)]*\)|[^=>\s]+)\s*=>\s*(?:\{|\b)", ("=>",), 1),
    spec("method", name_then(r"\w", r"\w", r"\s*\([^)]*\)\s*\{", skip=r"\s*\([^)]*+"), ("{",), 1),
]
CALLER = r"([a-zA-Z_$][a-zA-Z0-9_$.]*)\s*\(\s*$"
