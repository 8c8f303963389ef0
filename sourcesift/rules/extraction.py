"""Patterns of the normalisation and extraction operators.

Fixed values in this file: patterns, replacements, word lists and dictionaries decide the results.
"""

from __future__ import annotations

import re

from sourcesift.rules.model import name_then, span
from sourcesift.rules.surface import spec
from sourcesift.rules.symbols import SYMBOLS  # noqa: F401

# pattern, replacement, a literal that every match contains
NORMALISE_LITERALS = [
    (r"\b!0\b", "true", "!0"), (r"\b!1\b", "false", "!1"), (r"\bvoid\s+0\b", "undefined", "void"),
    (r"\bvoid\(0\)", "undefined", "void(0)"), (r"\b!!\[\]", "true", "!![]"), (r"\b!\[\]", "false", "![]"), (r"\+\[\]", "0", "+[]"),
]
CLEANUP_BUNDLE = [
    (r"\(0\s*,\s*([A-Za-z_$][A-Za-z0-9_$.]*)\)\s*\(", "{1}(", "(0"),
    (r"__webpack_require__", "require", "__webpack_require__"),
    (r"""Object\.defineProperty\s*\(\s*\w+\s*,\s*["']__esModule["']\s*,\s*\{[^}]*\}\s*\)\s*;?""", "/* ESModule */", "__esModule"),
    (r"/\*\*\*/\s*\(function\s*\(", "/* webpack-module */ (function(", "/***/"),
    (r"/\*\s*!eval\s*\*/", "/* eval */", "!eval"),
]
BRACKETS_TO_DOTS = [(r"""\[\s*["'](\w+)["']\s*\]""", ".{1}", "[")]
# &amp; comes last so that a decoded ampersand never starts a second decoding
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]
ENTITY = r"&(?:amp|lt|gt|quot|apos|nbsp);"
UNICODE_ESCAPES = (r"\\u\{[0-9a-fA-F]{1,6}\}", r"\\u[0-9a-fA-F]{4}")
HEX_ESCAPE = r"\\x[0-9a-fA-F]{2}"


def literal(once: str = "+") -> str:
    """Every encoded literal, one group per kind in the order of ``LITERAL_KINDS``; ``once`` repeats list items."""
    joined = rf"""(["'][^"']*["'](?:\s*\+\s*["'][^"']*["']){once})"""
    listed = rf"""\[\s*((?:["'][^"']*["']\s*,?\s*){once})\]\s*\.\s*join\s*\(\s*["']\s*["']\s*\)"""
    return "|".join([
        r"String\.fromCharCode\s*\(([^)]+)\)", r"""atob\s*\(\s*["']([A-Za-z0-9+/=]+)["']\s*\)""",
        r"\[([0-9a-fA-FxX,\s]+)\]", joined, listed,
    ])


LITERAL_KINDS = ("char_codes", "base64", "hex_array", "concat", "array_join")
LITERAL_SIGNS = ("String.fromCharCode", "atob", "0x", "join")
JOINED_SIGN = r"""["']\s*\+\s*["']"""
#: A literal inside another is decoded a round later; there are at most so many rounds.
LITERAL_ROUNDS = 10
STRING_LITERAL = r"""["']([^"']*)["']"""

ALIAS = [spec("alias", r"(?:var|const|let)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*d\((\d+)\)", ("d(",), 2)]
MODULE_NAMES = {
    2615: "@angular/core", 9330: "@angular/common/http", 3664: "@angular/core/rendering",
    5312: "environment", 7916: "configuration-service", 9437: "rxjs/operators/catchError",
    6354: "rxjs/operators/map", 9711: "rxjs/operators", 7810: "rxjs/operators2",
    6556: "rxjs/operators3", 1943: "@angular/router", 5416: "@angular/material/snack-bar",
    1585: "@angular/material/dialog", 4382: "socket.io-client", 9946: "jwt-decode",
    5635: "@ngx-translate/core", 3955: "@ngx-translate/core2", 2629: "@angular/material/button",
    455: "@angular/router-link", 8834: "@angular/material/icon", 9417: "@angular/forms",
    1228: "@angular/common", 3746: "@angular/forms2", 9588: "@angular/forms3",
    6192: "@angular/material/table", 882: "@angular/material/sidenav",
    6471: "@angular/material/card", 3902: "@angular/material/list", 3029: "ngx-highlightjs",
    7468: "rxjs/forkJoin", 3869: "@angular/cdk/collections", 6369: "ngx-highlightjs2",
    4843: "rxjs/firstValueFrom", 9183: "@angular/cdk/drag-drop", 2578: "file-saver",
    6648: "rxjs/from", 4257: "@angular/platform-browser-dynamic", 8132: "@angular/common/http2",
    5951: "@angular/cdk/portal", 2496: "@angular/material/autocomplete", 7200: "ng2-file-upload",
    8288: "qrcode", 4370: "ngx-text-diff", 107: "ngx-gallery", 767: "@angular/common/location",
}
MODULE_HINTS = [
    (r"@angular/core", "@angular/core"), (r"@angular/common", "@angular/common"),
    (r"@angular/router", "@angular/router"), (r"@angular/forms", "@angular/forms"),
    (r"@angular/material", "@angular/material"), (r"@angular/cdk", "@angular/cdk"),
    (r"@angular/platform-browser", "@angular/platform-browser"), (r"rxjs[/\\]", "rxjs"),
    (r"socket\.io", "socket.io"), (r"jwt-decode", "jwt-decode"),
    (r"ngx-translate|@ngx-translate", "@ngx-translate/core"), (r"ng2-file-upload", "ng2-file-upload"),
    (r"ngx-highlightjs", "ngx-highlightjs"), (r"ngx-gallery", "ngx-gallery"),
    (r"file-saver", "file-saver"), (r"qrcode", "qrcode"), (r"ngx-text-diff", "ngx-text-diff"),
    (r"environment", "environment"), (r"@ngrx", "@ngrx/store"), (r"lodash", "lodash"),
    (r"moment", "moment"), (r"axios", "axios"), (r"jquery", "jquery"), (r"d3\.", "d3"),
    (r"marked", "marked"), (r"node-fetch", "node-fetch"), (r"minimatch", "minimatch"),
    (r"express", "express"), (r"zone\.js", "zone.js"), (r"tslib", "tslib"),
    (r"core-js", "core-js"), (r"webpack", "webpack"),
]

SYMBOL_GATES = {
    "vue": r"__vccOpts|createElementVNode|openBlock|__vueParentComponent",
    "react": r"React\.createElement|__reactFiber|jsx-runtime|react-dom",
    "svelte": r"SvelteComponent|mount_component|create_fragment|svelte/internal",
    "nextjs": r"__NEXT_DATA__|next/dist|_next/static|usePathname",
    "lodash": r"import\s+_\s+from|lodash-es|_\.map\(|_\.filter\(",
    "date-fns": r"date-fns|parseISO|formatISO|differenceInDays",
    "zod": r"z\.object|z\.string|\.safeParse|zod",
    "zustand": r"create.*store|useStore|devtools.*zustand|zustand",
    "immer": r"produce|createDraft|finishDraft|immer",
}
CALL_NAMES = [
    spec("call", name_then("[A-Za-z0-9_$]", "[A-Za-z0-9_$]", r"\s*\("), ("(",), 1),
    spec("member", r"\b([A-Za-z]{1,2}\.[A-Za-z]{1,2})\b", (".",), 1),
]

METRICS = {
    "functions": r"(?:function\s*\*?\s*\w*\s*\(|=>\s*\{|\b(?:async\s+)?function\s*\()",
    "classes": r"\bclass\s+\w+",
    "components": r"ɵɵdefineComponent",
    "services": r"ɵɵdefineInjectable",
    "pipes": r"ɵɵdefinePipe",
    "directives": r"ɵɵdefineDirective",
    "react_components": r"(?:function|const)\s+[A-Z][A-Za-z0-9]+\s*(?:=\s*(?:\([^)]*\)|[A-Za-z_$])\s*=>|\([^)]*\)\s*\{)[^}]*(?:return\s*(?:<|jsx|createElement))",
    "vue_components": r"createElementVNode|defineComponent|__vccOpts",
    "svelte_components": r"SvelteComponent|create_fragment",
    "http_calls": r"this\.\w+\.(?:get|post|put|delete|patch)\s*\(",
    "eval_calls": r"\beval\s*\(",
    "decisions": r"\bif\b|\belse\b|\bfor\b|\bwhile\b|\bcase\b|\bcatch\b|\?\s*[^:]",
}
METRIC_LISTS = {
    "route_guards": r"canActivate\s*:\s*\[([^\]]+)\]",
    "socket_emits": r"""\.emit\s*\(\s*["']([^"']+)["']""",
    "socket_ons": r"""\.on\s*\(\s*["']([^"']+)["']""",
}
STRINGS = "|".join(rf"{q}[^{q}\\]*(?:\\[\w\W][^{q}\\]*)*(?:{q}|$)" for q in "\"'`")

COMPONENTS = {
    "angular_components": r"ɵɵdefineComponent2?\s*\(|ɵcmp\s*[:=]",
    "angular_services": r"ɵɵdefineInjectable\s*\(|ɵprov\s*[:=]",
    "angular_pipes": r"ɵɵdefinePipe\s*\(|ɵpipe\s*[:=]",
    "angular_directives": r"ɵɵdefineDirective\s*\(|ɵdir\s*[:=]",
    "vue_nodes": r"(?:createElementVNode|openBlock)\s*\(|__vccOpts\s*[:=]",
    "vue_apps": r"(?:createApp|defineComponent)\s*\(",
    "react_components": r"(?:createElement|createElementWithValidation|jsx|jsxs|jsxDEV)\s*\(",
    "svelte_components": r"create_fragment\s*\(",
    "functions": r"\bfunction\s+\w+\s*\(",
    "arrow_functions": r"=>",
    "classes": r"\bclass\s+\w+",
    "decisions": r"\bif\s*\(|\bfor\s*\(|\bwhile\s*\(|\bcase\b|\bcatch\b|\?[^:.?]|&&|\|\|",
}

STORAGE = [
    spec("web", r"""(localStorage|sessionStorage)\.(getItem|setItem|removeItem|clear)\s*\(\s*["']([^"']+)["']""",
         ("Storage.",), 3),
    spec("cookie", r"""(cookieService)\.(get|put|remove)\s*\(\s*["']([^"']+)["']""", ("cookieService.",), 3),
]
SENSITIVE_KEY = r"(?i)token|password|secret|auth|credential|session|jwt|totp|key|email"
SENSITIVE_ROUTE = r"(?i)admin|account|wallet|score|payment|order|data.?export|2fa|two.?factor|deluxe|membership|recycl|address|profile|change.?pass|reset.?pass"
GUARDED_ROUTE = [
    spec("guarded", r"""path\s*:\s*["']([^"']{0,120})["'][^{};]{0,400}?canActivate\s*:\s*\[([^\]]+)\]""", ("canActivate",), 2)
]
ANY_ROUTE = [
    spec("route", r"""path\s*:\s*["']([^"']{1,120})["'][^{};]{0,400}?(?:component|loadChildren)\s*:""", ("path",), 1)
]
ENDPOINT = [
    spec("endpoint", r"""this\.\w+\.(?:get|post|put|delete|patch)\s*<[^>]*>\s*\(\s*["'`]([^"'`]+)["'`]""", ("this.",), 1)
]
AUTH_WORDS = r"(?i)Authorization|Bearer|x-auth-token|token|jwt"
GUARD_WORDS = r"(?i)canActivate|AuthGuard|auth\.isLoggedIn"
REVERSIBLE = [spec("btoa", r"btoa\s*\(([^)]{0,120}(?:split|reverse)[^)]{0,120})\)", ("btoa",), 1)]

# name, pattern, refusing pattern on the head of the text, head length, unique markers
FRAMEWORKS = [
    ("Angular", r"ɵɵdefineComponent|angular\.json|NgModule|@angular/", None, 0,
     (r"@Component\s*\(", r"@NgModule\s*\(", r"@Injectable\s*\(", r"""from\s*['"]@angular/core['"]""", r"ɵɵdefineComponent")),
    ("Webpack 5", r"webpackChunk[a-zA-Z]|__webpack_require__|self\.webpackChunk", None, 0, ()),
    ("Socket.io", r"""socket\.io|io\.connect|io\(\)|\.emit\(|\.on\("connect"\)""", None, 0, ()),
    ("RxJS", r"BehaviorSubject|switchMap|catchError|combineLatest|pipe\(", None, 0, ()),
    ("Svelte", r"SvelteComponent|mount_component|create_fragment|svelte/internal", r"(?i)angular|react", 2000, ()),
    ("Next.js", r"__NEXT_DATA__|next/dist|_next/static|usePathname|__N_SSP", None, 0, ()),
    ("Vite", r"__vitePreload|import\.meta\.hot|__vite__mapDeps|@vite/client", None, 0, ()),
    ("Vue", r"""from\s*['"]vue['"]|createApp\s*\(|defineComponent\s*\(\s*\{|__vccOpts|createElementVNode|Vue\.extend\s*\(|new\s+Vue\s*\(""",
     r"@angular/|ɵɵ|NgModule", 5000,
     (r"""from\s*['"]vue['"]""", r"createApp\s*\(", r"defineComponent\s*\(\s*\{", r"new\s+Vue\s*\(")),
    ("React", r"React\.createElement|ReactDOM\.render|useState\s*\(|jsx-runtime", None, 0, ()),
    ("Express", r"""app\.(?:get|post|put|delete|use)\s*\(\s*["']/""", r"angular|router\.navigate", 3000, ()),
    ("jQuery", r"\$\s*\(\s*document\s*\)|jQuery\s*\(", None, 0, ()),
    ("Lodash", r"""import\s+_\s+from\s+['"]lodash["']|_\.map\(|_\.filter\(""", None, 0, ()),
    ("D3", r"d3\.select|d3\.scale|d3\.arc", None, 0, ()),
]

ROUTES = [
    spec("REST", r"""["'](/(?:api|rest|graphql|v\d+)/[^"'\s<>{}|\\^`[\]]{1,120})["']""", ("/",), 1),
    spec("HTTP", r"""(?:fetch|axios\.(?:get|post|put|delete)|http\.(?:get|post|put|delete))\s*\(\s*["']([^"']+)["']""",
         ("fetch", "axios.", "http."), 1),
    spec("Angular", r"""path\s*:\s*["']([^"']{0,120})["'][^{};]{0,400}?(?:component|loadChildren)\s*:""", ("path",), 1),
    spec("Wildcard", r"""path\s*:\s*["']\*\*["']""", ("**",)),
    spec("Angular-Parent",
         r"""path\s*:\s*["']([^"']{1,80})["'][^;]{0,100}children\s*:\s*\[([^\]]{0,1000}[^\]]{0,1000})\]""", ("children",), 2),
    spec("Angular-Child", r"""(?:=\s*)?\(\s*\)\s*(?:=\s*>|=>)\s*\[\s*["']([a-zA-Z0-9_\-/]{3,80})["']\s*\]""", ("=>",), 1),
    spec("Angular-RouterLink", r"""["']routerLink["']\s*,\s*["']([^"']{1,120})["']""", ("routerLink",), 1),
    spec("Angular-Nav", r"""router\.navigate\s*\(\s*\[\s*["']([a-zA-Z0-9_\-/]{2,80})["']""", ("router.navigate",), 1),
    spec("WebSocket", r"""wss?://[^\s"'<>]{4,80}""", ("ws",)),
    spec("GraphQL", r"(?:query|mutation|subscription)\s+\w+", ("query", "mutation", "subscription")),
    spec("Next.js", r"""["'](/(?:app|pages)/[^"'\s]{1,80})["']""", ("/app/", "/pages/"), 1),
]
CHILD_PATH = r"""path\s*:\s*["']([^"']{1,80})["']"""
HIDDEN_ROUTE = r"^[a-z0-9][a-z0-9\-_/]{2,}$"

PACKAGE_REF = [
    spec("ref", r"""(?i)["']([a-z@][a-z0-9_\-./]*)["']\s*[:=,]\s*["']([0-9^~><= .]{1,20})["']""", (), 2)
]
# package, first fixed version, advisory, severity
VULNERABLE = [
    ("lodash", (4, 17, 21), "CVE-2021-23337", "high"),
    ("axios", (0, 21, 1), "CVE-2020-28168", "medium"),
    ("jquery", (3, 5, 0), "CVE-2020-11022", "high"),
    ("angular/core", (12, 0, 0), "CVE-2021-4231", "high"),
    ("socket.io", (4, 0, 0), "CVE-2020-28467", "high"),
    ("moment", (2, 29, 2), "CVE-2022-24785", "medium"),
    ("d3", (7, 0, 0), "CVE-2019-1000016", "medium"),
    ("marked", (4, 0, 10), "CVE-2022-21681", "high"),
    ("node-fetch", (2, 6, 7), "CVE-2022-0235", "high"),
    ("minimatch", (3, 0, 5), "CVE-2022-3517", "high"),
]


def _version_refs() -> list:
    """A package's own notations: ``name@1.2``, and for some its quoted name with a quoted number behind it on the line."""
    out = []
    for package, *_ in VULNERABLE:
        name, flag = re.escape("@" * (package == "angular/core") + package).replace("\\-", "-"), "(?i)" * (package == "jquery")
        gate = (package,)
        out.append(spec(f"{package}:at", f"{flag}{name}@([0-9.]+)", gate, 1))
        if package in ("lodash", "axios", "jquery", "d3"):
            quoted = span(f"{flag}[\"']{name}[\"']", ".", "[\"']([0-9.]+)[\"']", lazy=True)
            out.append(spec(f"{package}:quoted", quoted, gate, 1))
    return out


VERSION_REFS = _version_refs()

BUNDLERS = [
    ("Vite", r"__vitePreload|import\.meta\.hot|__vite__mapDeps|@vite/client",
     (r"__vitePreload", r"import\.meta\.hot", r"__vite__mapDeps")),
    ("Rollup", r"var\s+__defProp\s*=|var\s+__export\s*=|var\s+__esm\s*=|var\s+__commonJS\s*=|var\s+__toESM\s*=|var\s+__async\s*=",
     (r"__defProp", r"__export", r"__esm", r"__commonJS")),
    ("ESM", r"""\bimport\s+(?:\*\s+as\s+|\{[^}]*\}\s+)?[a-zA-Z_$][a-zA-Z0-9_$]*\s+from\s+["']|\bimport\s+\{[^}]*\}\s+from\s+["']""",
     (r"\bimport\s+[a-zA-Z_$]", r"\bimport\s*\{", r"\bexport\s+(?:default|const|function|class|interface|type|\{)")),
    ("Parcel", r"parcelRequire|define\(\s*\d+\s*,\s*function", (r"parcelRequire", r"\bdefine\(\d+")),
    ("esbuild", r"var\s+__require\s*=|var\s+__commonJS\s*=|init_", (r"__require", r"init_")),
]

ENTRY_POINTS = [
    spec("Angular:ngOnInit", r"\bngOnInit\s*\(\s*\)\s*\{", ("ngOnInit",)),
    spec("EventListener:", r"""\.addEventListener\s*\(\s*["']([^"']+)["']\s*,""", (".addEventListener",), 1),
    spec("React:useEffect", r"useEffect\s*\(\s*\(", ("useEffect",)),
    spec("Express:handler", r"""app\.(?:get|post|put|delete)\s*\(\s*["']/""", ("app.",)),
    spec("Socket:", r"""\.on\s*\(\s*["']([^"']+)["']\s*,""", (".on",), 1),
    spec("Class:constructor", r"\bconstructor\s*\(", ("constructor",)),
]
