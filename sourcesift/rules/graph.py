"""Patterns of the module graph operators. They decide what is a module or a call."""

from __future__ import annotations

from sourcesift.rules.model import span

CHUNK_HEAD = r"\[\[(\d+)\]\s*,\s*\{"
MODULE_LINE = r"(?m)^(\d+):\s*\((?:Q|module),\s*(?:H|exports),\s*(?:d|require)\)"
PUSHED_CHUNK = r"""self\[\s*["']webpackChunk["']\s*\]\.push\s*\(\s*\[\[\s*(\d+)\s*\]\s*,\s*\{"""
LISTED_CHUNK = r"\[\[\s*(\d+)\]\s*,\s*\{"
MODULE_FUNCTION = r"(\d+)\s*:\s*(?:function\s*\([^)]*\)|\([^)]*\)\s*=>)\s*\{"
ROLLUP_FILE = r"//\s+([a-zA-Z0-9_\-./]+\.(?:js|ts|jsx|tsx|vue|svelte))\s*\n(?:var|const|let|function|class)"
PARCEL_DEFINE = r"\bdefine\(\s*(\d+)\s*,\s*function\s*\("
ESBUILD_FILE = r"//\s+([a-zA-Z0-9_\-./]+)\s*\n(?:function\s+\w+\s*\(|/\*\s*)"
ESM_IMPORT = r"""import\s+(?:\{[^}]*\}\s+from\s+["']([^"']+)["']|(?:\*\s+as\s+)?(\w+)\s+from\s+["']([^"']+)["']|["']([^"']+)["'])"""
ESM_EXPORT = r"\bexport\s+(default\s+)?(const|function|class)\s+(\w+)"

USES = r"d\((\d+)\)"
D_CALL = r"\bd\s*\(\s*(\d+)\s*\)"
REQUIRE_CALL = r"\brequire\s*\(\s*(\d+)\s*\)"
REQUIRE_NAME = r"""require\(["']([^"']+)["']\)"""

IMPORTS = [
    ("require", r"""\brequire\s*\(\s*["']([^"']+)["']\s*\)"""),
    ("import", r"""\bimport\s+(?:\*\s+as\s+\w+\s+from\s+)?["']([^"']+)["']\s*;?"""),
    ("dynamic-import", r"""\bimport\s*\(\s*["']([^"']+)["']\s*\)"""),
]
EXPORTS = [
    ("module-exports", r"module\.exports\s*=\s*(\w+)"),
    ("named-export", r"exports\.(\w+)\s*="),
    ("export-default", r"\bexport\s+default\s+(\w+)"),
    ("export-named", r"(\bexport\s+\{[^}]+\})"),
]
CALLS = [
    ("http-call", r"this\.\w+\.(get|post|put|delete|patch|request)\s*\("),
    ("socket-emit", r"""\.emit\s*\(\s*["']([^"']+)["']"""),
    ("socket-on", r"""\.on\s*\(\s*["']([^"']+)["']"""),
    ("router-navigate", r"(router\.navigate)\s*\("),
    ("module-dep", D_CALL),
    ("http-fetch", r"\b(fetch|axios\.\w+|http\.\w+)\s*\("),
    ("router-link", span(r"""["']routerLink["']""", ".", r"""["']([^"']+)["']""", lazy=True)),
]
ROUTE_PATH = r"""path\s*:\s*["']([^"']+)["']"""
HAS_GUARD = r"canActivate|AuthGuard"
GUARD_LIST = r"canActivate\s*:\s*\[([^\]]+)\]"
ADMIN_NAME = r"admin|dashboard|panel|manage"
UNNAMED = r"module-\d+"

# name, weight, imports, markers
SIGNATURES = [
    ("Angular", 10,
     ("@angular/core", "@angular/common", "@angular/router", "@angular/forms", "@angular/material", "@angular/cdk",
      "@angular/platform-browser", "@angular/animations", "@angular/http", "@angular/elements"),
     ("ɵɵ", "ɵcmp", "ɵfac", "ɵprov", "ɵpipe", "ɵdir", "ɵmod", "ɵinj", "Component({", "NgModule({", "Injectable({")),
    ("React", 8,
     ("react", "react-dom", "react/jsx-runtime", "react/jsx-dev-runtime", "react-native", "next/link", "next/router", "next/head"),
     ("React.createElement", "createElement", "jsx(", "jsxs(", "jsxDEV(", "useState(", "useEffect(", "useCallback(", "useMemo(")),
    ("Vue", 8, ("vue", "vue-router", "vuex", "pinia", "nuxt"),
     ("createElementVNode", "openBlock", "createApp(", "defineComponent({", "__vccOpts", "createVNode")),
    ("Svelte", 7,
     ("svelte", "svelte/internal", "svelte/store", "svelte/transition", "svelte/animate", "svelte/easing"),
     ("SvelteComponent", "create_fragment", "mount_component", "svelte/internal")),
    ("Next.js", 6,
     ("next", "next/dist", "next/link", "next/router", "next/head", "next/image", "next/script"),
     ("__NEXT_DATA__", "usePathname", "useSearchParams", "_next/static", "__N_SSP", "__N_SSG")),
    ("Express", 5, ("express", "body-parser", "cors", "morgan", "helmet"),
     ("app.get(", "app.post(", "app.use(", "express()", "Router()")),
    ("Lodash", 3, ("lodash", "lodash-es"), ("_.map(", "_.filter(", "_.find(", "_.forEach(", "lodash")),
    ("RxJS", 4, ("rxjs", "rxjs/operators"), ("BehaviorSubject", "Observable", "pipe(", "subscribe(")),
    ("Socket.io", 5, ("socket.io", "socket.io-client"), ("io(", "io.connect", "socket.on(", "socket.emit(")),
    ("jQuery", 3, ("jquery", "jquery-ui"), ("$(", "jQuery(", "$.ajax", "$.get", "$.post")),
]
EDGE_COLOURS = {"http": "#44cc88", "socket-emit": "#ff8844", "socket-on": "#ff44cc", "dep": "#4488ff"}
