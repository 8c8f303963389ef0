"""Patterns of the network, WebAssembly and fallback taint scanners."""

from __future__ import annotations

from sourcesift.rules.model import Rule, span


def spec(rule_id: str, pattern: str, gate: tuple[str, ...] = (), groups: int = 0, **more) -> Rule:
    return Rule(rule_id, more.pop("severity", "info"), more.pop("category", ""), pattern, gate, groups, **more)


# Fixed values in this file: ids, patterns, host lists and labels decide what is reported.
_REST_OF_PATH = r"""(?:/[^\s"'<>{}|\\^`[\]]*)?"""
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NETWORK = [
    spec("url", r"https?://[a-zA-Z0-9._\-:~]+(?::\d{2,5})?" + _REST_OF_PATH, ("http",)),
    spec("ws", r"wss?://[a-zA-Z0-9._\-~]+(?::\d{2,5})?" + _REST_OF_PATH, ("ws",)),
    spec("graphql", r"/graphql|/api/graphql|/gql|/query", ("/",)),
    spec("api", r"""["'`](/(?:api|rest|v\d+|service|backend)/[a-zA-Z0-9_\-/.{}[\]$]+(?:\.(?:json|xml|html))?)["'`]""",
         ("/",), 1),
    spec("host", r"""["'`]([a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z]{2,})+)(?::\d{2,5})?["'`]""",
         (".",), 1),
    spec("ip", rf"\b(?:{_OCTET}\.)" + "{3}" + rf"{_OCTET}\b", (".",)),
    spec("meta", r"(?:169\.254\.169\.254|metadata\.google\.internal|metadata\.amazonaws\.com|169\.254\.170\.\d+)",
         ("169.254.", "metadata.")),
    spec("internal", r"(?i)(?:localhost|local|dev|staging|internal|intranet|corp|private)(?:\.[a-zA-Z.]+)?\b",
         ("local", "dev", "staging", "internal", "intranet", "corp", "private")),
]
IPV4 = rf"^(?:{_OCTET}\.)" + "{3}" + rf"{_OCTET}$"
CDN_HOSTS = r"cdn\.jsdelivr|cdnjs\.cloudflare|unpkg|googleapis|gstatic|facebook|twitter"
METADATA_HOSTS = NETWORK[6].pattern
COMMON_HOSTS = r"^(example|test|localhost|\.local|\.test)$|accounts\.google|cdnjs\.cloudflare|openstreetmap"
PRIVATE_RANGES = [
    (r"^10\.", "Class A private"),
    (r"^172\.(?:1[6-9]|2\d|3[01])\.", "Class B private"),
    (r"^192\.168\.", "Class C private"),
    (r"^127\.", "Loopback"),
    (r"^0\.", "Current network"),
]

WASM = [
    spec("base64",
         r"""WebAssembly\.(?:instantiate|compile|instantiateStreaming)\s*\([^)]*Uint8Array\.from\s*\(\s*(?:atob|Buffer\.from)\s*\(\s*["']([A-Za-z0-9+/=]{100,})["']""",
         ("WebAssembly.",), 1),
    spec("bytes", r"WebAssembly\.compile\s*\(\s*new\s+Uint8Array\s*\(\s*\[([\d,\sa-fA-Fx]+)\]\)",
         ("WebAssembly.compile",), 1),
    spec("fetch", r"""WebAssembly\.instantiateStreaming\s*\(\s*fetch\s*\(\s*["']([^"']+)["']""",
         ("WebAssembly.instantiateStreaming",), 1),
]
WASM_MAGIC = "0061736D"

FALLBACK_SOURCES = [
    spec("URL parameter", r"location\.(?:hash|search|href|pathname)", ("location.",)),
    spec("Document property", r"document\.(?:URL|referrer|cookie)", ("document.",)),
    spec("Event data (postMessage/WebSocket)", r"(?:event|e)\.data\b", (".data",)),
    spec("localStorage", span(r"localStorage\.getItem\s*\(", "[^)]", r"\)", least=1), ("localStorage.",)),
    spec("sessionStorage", span(r"sessionStorage\.getItem\s*\(", "[^)]", r"\)", least=1), ("sessionStorage.",)),
    spec("window.name", r"window\.name\b", ("window.name",)),
    spec("URLSearchParams", r"URLSearchParams[^;]{0,100}\.get\s*\(", ("URLSearchParams",)),
    spec("Angular route params", r"activatedRoute\.(?:queryParams|params|snapshot\.params)\b", ("activatedRoute.",)),
    spec("Angular route paramMap", r"this\.route\.snapshot\.(?:paramMap|queryParamMap)\.get", (".snapshot.",)),
    spec("form control value", r"FormGroup\.value\b", ("FormGroup.value",)),
    spec("input value", r"""\.value\s*(?:!==|===|==)\s*["']""", (".value",)),
    spec("postMessage", r"postMessage\s*\(", ("postMessage",)),
    spec("MessageEvent", r"new\s+MessageEvent", ("MessageEvent",)),
    spec("HTTP response data", r"responseText|response\.data\b", ("responseText", "response.data")),
]
FALLBACK_SINKS = [
    spec("innerHTML", r"\.innerHTML\s*=", (".innerHTML",), severity="critical", cwe="CWE-79"),
    spec("outerHTML", r"\.outerHTML\s*=", (".outerHTML",), severity="critical", cwe="CWE-79"),
    spec("insertAdjacentHTML", r"\.insertAdjacentHTML\s*\(", (".insertAdjacentHTML",), severity="critical", cwe="CWE-79"),
    spec("document.write", r"document\.write\s*\(", ("document.write",), severity="critical", cwe="CWE-79"),
    spec("eval()", r"\beval\s*\(", ("eval",), severity="critical", cwe="CWE-95"),
    spec("Function()", r"new\s+Function\s*\(", ("Function",), severity="critical", cwe="CWE-95"),
    spec("location navigation", r"location\.(?:href|replace|assign)\s*=", ("location.",), severity="high", cwe="CWE-601"),
    spec("setAttribute(on*)", r"""\.setAttribute\s*\(\s*['"]on\w+['"]""", (".setAttribute",), severity="critical", cwe="CWE-79"),
    spec("Angular [innerHTML]", r"\[innerHTML\]", ("[innerHTML]",), severity="critical", cwe="CWE-79"),
    spec("React dangerouslySetInnerHTML", r"dangerouslySetInnerHTML", ("dangerouslySetInnerHTML",), severity="critical", cwe="CWE-79"),
    spec("Vue v-html", r"v-html\s*=", ("v-html",), severity="critical", cwe="CWE-79"),
    spec("iframe srcdoc", r"srcdoc\s*=", ("srcdoc",), severity="critical", cwe="CWE-79"),
    spec("jQuery DOM manip", r"(?:\.html\(|\.append\(|\.prepend\(|\.after\(|\.before\(|\.replaceWith\()",
         (".html(", ".append(", ".prepend(", ".after(", ".before(", ".replaceWith("), severity="high", cwe="CWE-79"),
    spec("jQuery .html()", span(r"\$\s*\(", "[^)]", r"\)\s*\.html\s*\("), (".html",), severity="critical", cwe="CWE-79"),
    spec("Range.createContextualFragment", r"createContextualFragment", ("createContextualFragment",), severity="critical", cwe="CWE-79"),
    spec("DOMParser", r"DOMParser\(\)\.parseFromString", ("DOMParser",), severity="medium", cwe="CWE-79"),
]
