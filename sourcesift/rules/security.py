"""General security rules: dangerous sinks, weak crypto, storage, leakage, uploads."""

from __future__ import annotations

from sourcesift.rules.model import LINE_END, Guard, Rule, drop, keep, span

_XSS, _INJ, _CRYPTO = "XSS", "Injection", "Broken Crypto"
_NG, _PROTO, _LEAK = "Angular Security", "Prototype Pollution", "Info Leakage"
_WORKER, _UPLOAD = "Web Worker", "File Upload"


def _rule(rule_id, category, severity, pattern, gate, guards=(), groups=0):
    return Rule(
        rule_id=rule_id,
        severity=severity,
        category=category,
        pattern=pattern,
        gate=gate,
        groups=groups,
        value="g1" if groups else "match",
        value_len=100,
        guards=guards,
        context=(100, 120),
        trim=True,
        dedupe="value",
    )


def _keep(regex: str) -> tuple[Guard, ...]:
    return (keep(regex, 100, 120),)


def _drop(regex: str) -> tuple[Guard, ...]:
    return (drop(regex, 100, 120),)


# Ids, categories, severities and patterns decide which matches are reported.
SECURITY = [
    _rule("xss-write", _XSS, "critical", r"document\.write\s*\(", ("document.write",),
          _drop(r"// test")),
    _rule("xss-innerhtml", _XSS, "high", r"\.innerHTML\s*=", (".innerHTML",),
          (drop(r"sanitize|DomSanitizer|bypassSecurityTrust", 100, 120, last=200),)),
    _rule("xss-eval", _XSS, "critical", r"\beval\s*\(", ("eval",)),
    _rule("xss-new-func", _XSS, "critical", r"new\s+Function\s*\(", ("Function",)),
    _rule("sqli-concat", _INJ, "high", r"""(?i)(?:query|sql|exec)\s*=\s*["'][^"']*["']\s*\+""",
          ("query", "sql", "exec"), _drop(r"placeholder|label|aria")),
    _rule("cmd-injection", _INJ, "critical",
          span(r"child_process|exec\s*\(\s*", "[^)]", r"\+", stop="child_process"),
          ("child_process", "exec")),
    _rule("crypto-broken-entropy", _CRYPTO, "critical",
          span(r"btoa\s*\(", "[^)]", r"""\.split\s*\(\s*["']["']\s*\)\.reverse"""), ("btoa",)),
    _rule("crypto-weak-hash", _CRYPTO, "high", r"(?i)(?:MD5|sha1|SHA1)\s*\(", ("md5", "sha1"),
          _drop(r"(?i)comment|hmac")),
    _rule("crypto-math-random", _CRYPTO, "medium", r"Math\.random\s*\(\s*\)", ("Math.random",),
          (keep(r"(?i)password|secret|token|key|nonce", 100, 100),)),
    _rule("network-socket", "Network", "info",
          r"""socket\.io|\.on\s*\(\s*["'](?:connect|message|data)""", ("socket.io", ".on")),
    _rule("network-socket-emit", "Network Surface", "medium",
          r"""\.emit\s*\(\s*["']([^"']+)["']""", (".emit",), groups=1),
    _rule("network-http-open", "Network", "info", r"""https?://[^\s"']+""", ("http",),
          _drop(r"accounts\.google|cdnjs\.cloudflare|openstreetmap")),
    _rule("storage-local", "Storage", "medium", r"localStorage\.", ("localStorage.",)),
    _rule("storage-session", "Storage", "medium", r"sessionStorage\.", ("sessionStorage.",)),
    _rule("storage-cookie", "Storage", "low", r"document\.cookie", ("document.cookie",)),
    _rule("pii-email-field", "PII", "low", r"\.email\s*=|email\s*:", ("email",),
          _drop(r"placeholder|label|aria")),
    _rule("angular-guard", "Auth Surface", "info",
          span(r"canActivate\s*:\s*\[", r"[^\]]", r"\]", least=1, group=True), ("canActivate",), groups=1),
    _rule("angular-bypass", _NG, "high",
          r"bypassSecurityTrust(?:Html|Url|ResourceUrl|Script|Style)", ("bypassSecurityTrust",)),
    _rule("xss-outerhtml", _XSS, "critical", r"\.outerHTML\s*=", (".outerHTML",)),
    _rule("xss-insertadj", _XSS, "critical", r"\.insertAdjacentHTML\s*\(", (".insertAdjacentHTML",)),
    _rule("xss-srcdoc", _XSS, "critical", r"\.srcdoc\s*=", (".srcdoc",)),
    _rule("xss-createfrag", _XSS, "high", r"createContextualFragment\s*\(",
          ("createContextualFragment",)),
    _rule("xss-jquery-html", _XSS, "critical",
          span(r"(?:jQuery|\$)\s*\(", "[^)]", r"\)\.html\s*\([^)]+\)"), (".html",)),
    _rule("xss-jquery-dom", _XSS, "high",
          span(r"(?:jQuery|\$)\(", "[^)]", r"\)\.(?:append|prepend|after|before|wrap)\s*\([^)]+\)"),
          ("jQuery(", "$(")),
    _rule("xss-set-attr-on", _XSS, "critical", r"""\.setAttribute\s*\(\s*['"]on\w+['"]\s*,""",
          (".setAttribute",)),
    _rule("xss-location-href", _XSS, "high", r"(?:location|window\.location)\.href\s*=",
          ("location.href",), _drop(r"https?://")),
    _rule("xss-loc-replace", _XSS, "high", r"location\.(?:replace|assign)\s*\(",
          ("location.replace", "location.assign")),
    _rule("xss-window-open", _XSS, "medium", r"window\.open\s*\(", ("window.open",)),
    _rule("ng-tmpl-inject", _NG, "high",
          span("DomSanitizer", ".", r"""bypassSecurityTrustHtml\s*\(\s*[`'"]"""), ("DomSanitizer",)),
    _rule("ng-compile", _NG, "critical", r"\$compile\s*\(\s*", ("$compile",),
          (drop(r"""^\$compile\s*\(['"]""", 0, 40),)),
    _rule("proto-assign", _PROTO, "critical", r"(?:__proto__|prototype)\s*(?:\[|\.)",
          ("__proto__", "prototype")),
    _rule("proto-merge", _PROTO, "high",
          r"(?i)Object\.assign\s*\(\s*(?:target|obj|config|opts|options|settings)",
          ("object.assign",), _keep(r"(?i)user|request|input|body|data|param")),
    _rule("proto-setproto", _PROTO, "high", r"Object\.setPrototypeOf\s*\(",
          ("Object.setPrototypeOf",)),
    _rule("proto-jsonparse", _PROTO, "medium", span(r"JSON\.parse\s*\(", "[^)]", r"\)", least=1), ("JSON.parse",),
          _keep(r"(?i)user|request|input|body|data|param|__proto__|constructor")),
    _rule("postmsg-wildcard", "PostMessage", "high",
          span(r"\.postMessage\s*\(", "[^)]", r""",\s*['"][*]['"]""", least=1), (".postMessage",)),
    _rule("postmsg-nocheck", "PostMessage", "medium",
          r"""addEventListener\s*\(\s*['"]message['"]""", ("addEventListener",),
          _drop(r"event\.origin|e\.origin")),
    _rule("rand-date-token", _CRYPTO, "high",
          r"(?:Date\.now\(\)|new\s+Date\(\)\.getTime\(\))", ("Date.now()", "Date().getTime()"),
          _keep(r"(?i)token|nonce|csrf|session|secret|key|id|ref")),
    _rule("bypass-style", _NG, "high", r"bypassSecurityTrustStyle\s*\(",
          ("bypassSecurityTrustStyle",)),
    _rule("bypass-url", _NG, "critical", r"bypassSecurityTrustUrl\s*\(",
          ("bypassSecurityTrustUrl",)),
    _rule("bypass-resurl", _NG, "critical", r"bypassSecurityTrustResourceUrl\s*\(",
          ("bypassSecurityTrustResourceUrl",)),
    _rule("bypass-script", _NG, "critical", r"bypassSecurityTrustScript\s*\(",
          ("bypassSecurityTrustScript",)),
    _rule("err-console", _LEAK, "medium",
          r"console\.(log|error|warn|info)\s*\(\s*(?:error|err|e|ex)\b", ("console.",), groups=1),
    _rule("err-alert", _LEAK, "medium",
          r"alert\s*\(\s*(?:error|err|e|ex)(?:\.message|\.stack)?\s*\)", ("alert",)),
    _rule("err-tostring", _LEAK, "low",
          span(r"\.toString\s*\(\s*\)", ".", r"(?:innerHTML|textContent|innerText)\s*=", stop=r"\.toString[\s(]*" + LINE_END),
          (".toString",)),
    _rule("err-stacktrace", _LEAK, "high", r"(?:error|err|e)\.stack\b", (".stack",)),
    _rule("sourcemap-ref", _LEAK, "low", r"//[#@]\s*sourceMappingURL\s*=", ("sourceMappingURL",)),
    _rule("sourcemap-file", _LEAK, "low", r"""(?i)\.map["']\s*\)|\bsource-maps?\b""",
          (".map", "source-map")),
    _rule("worker-new", _WORKER, "info", r"""new\s+Worker\s*\(\s*(?:new\s+URL|['"`])""",
          ("Worker",)),
    _rule("worker-blob", _WORKER, "medium", r"new\s+Worker\s*\(\s*URL\.createObjectURL",
          ("URL.createObjectURL",)),
    _rule("worker-importscripts", _WORKER, "high", r"importScripts\s*\(", ("importScripts",)),
    _rule("upload-type-client", _UPLOAD, "medium",
          r"""(?i)\.type\.(?:includes?|startsWith|indexOf|match)\s*\(\s*['"](?:image|video|text|application)""",
          (".type.",)),
    _rule("upload-ext-client", _UPLOAD, "medium",
          span(r"(?i)\.name\.(?:endsWith|split|match)\s*\(", "[^)]", r"(?:jpg|png|pdf|zip|exe|svg)"),
          (".name.",)),
    _rule("upload-size-client", _UPLOAD, "low",
          r"\.size\s*(?:>|<|>=|<=|===)\s*\d+(?:\s*\*\s*1024)?", (".size",),
          _keep(r"(?i)file|upload|attach")),
]
