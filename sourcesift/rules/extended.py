"""Extended packs: dynamic code, business logic, sockets, crypto context, leakage and more."""

from __future__ import annotations

from sourcesift.rules.model import Guard, Rule, drop, keep, skip_names


def _r(rule_id, category, severity, pattern, gate, text, **more):
    return Rule(rule_id, severity, category, pattern, gate, description=text, **more)


# Fixed values in every list below: ids, categories, severities, patterns and window sizes decide
# which matches are reported.

_DYN = dict(category="Dynamic Code Execution", context=(75, 75))
DYNAMIC_CODE = [
    Rule("dyncode-setTimeout/Interval-string", "critical",
         pattern=r"""(?:setTimeout|setInterval)\s*\(\s*(["'`][^"'`]{0,200}["'`]|[A-Za-z_$][A-Za-z0-9_$.]*)\s*,""",
         gate=("setTimeout", "setInterval"), groups=1,
         guards=(Guard("match", r"""^(?:setTimeout|setInterval)\s*\(\s*function""", False),),
         description="Timer with a text or named callback", **_DYN),
    Rule("dyncode-Function-constructor", "critical", pattern=r"new\s+Function\s*\(",
         gate=("Function",), description="Code built from text by a constructor", **_DYN),
    Rule("dyncode-indirect-eval", "critical", pattern=r"\(\s*0\s*,\s*eval\s*\)\s*\(",
         gate=("eval",), description="Evaluation in the global scope", **_DYN),
    Rule("dyncode-execScript", "high", pattern=r"execScript\s*\(", gate=("execScript",),
         description="Old browser evaluation call", **_DYN),
    Rule("dyncode-WebAssembly", "medium",
         pattern=r"WebAssembly\.(?:instantiate|compile|instantiateStreaming)\s*\(",
         gate=("WebAssembly.",), description="Native code loaded at run time", **_DYN),
    Rule("dyncode-importScripts", "high", pattern=r"importScripts\s*\(\s*([^)]+)\)",
         gate=("importScripts",), description="Script pulled into a worker", **_DYN),
]

_BL = "Business Logic"
BUSINESS_LOGIC = [
    _r("bl-ratelimit", _BL, "medium",
       r"""(?i)localStorage\.(?:getItem|setItem)\s*\(\s*["'](?:last|prev|time|rate|limit)[^"']*["']""",
       ("localstorage.",), "Rate limit kept by the client"),
    _r("bl-balance", _BL, "high",
       r"(?i)(?:balance|wallet|credit|amount)\s*(?:<|>|<=|>=|===|!==)\s*(?:total|price|amount|cost|\d)",
       ("balance", "wallet", "credit", "amount"), "Balance compared by the client"),
    _r("bl-coupon", _BL, "high",
       r"(?i)(?:coupon|promo|discount|voucher)\s*(?:===|==|includes?|match)",
       ("coupon", "promo", "discount", "voucher"), "Coupon checked by the client"),
    _r("bl-hardcoded-coupon", _BL, "critical",
       r"""(?i)["'][A-Z0-9]{4,}['"]\s*(?:===|==)\s*(?:coupon|promo|code)""",
       ("coupon", "promo", "code"), "Coupon literal compared by the client"),
    _r("bl-access-control", _BL, "medium",
       r"""(?i)(?:role|admin|premium|deluxe|vip)\s*(?:===|==|!==|!=)\s*["']\w+["']""",
       ("role", "admin", "premium", "deluxe", "vip"), "Role compared by the client"),
    _r("bl-feature-flag", _BL, "low", r"(?i)(?:featureFlag|config|settings)\.\w+\s*(?:\?|&&)",
       ("featureflag", "config", "settings"), "Sensitive feature behind a client flag",
       guards=(keep(r"(?i)admin|premium|beta|internal|hidden", 100, 100),)),
]

_ON = r"""\.on\s*\(\s*["']([^"']+)["']\s*,\s*(?:function\s*\([^)]*\)|[^)=\s>]+\s*=>)\s*\{([^}]{0,400})\}"""
_ONMESSAGE = r"\.onmessage\s*=\s*(?:function\s*\([^)]*\)|[^=>\s]+\s*=>)\s*\{([^}]{0,400})\}"
_WS = dict(context=(125, 125), value="g1")
WEBSOCKET = [
    _r("ws-dom-sink", "WebSocket XSS", "critical", _ON, (".on",), "Socket data written to the page",
       groups=2, fmt='socket.on("{v}") → DOM sink', **_WS,
       guards=(Guard("g2", r"innerHTML|outerHTML|insertAdjacentHTML|document\.write|\.html\(", True),)),
    _r("ws-code-exec", "WebSocket Code Exec", "critical", _ON, (".on",), "Socket data evaluated as code",
       groups=2, fmt='socket.on("{v}") → eval/Function', **_WS,
       guards=(Guard("g2", r"eval\s*\(|new\s+Function", True),)),
    _r("ws-raw-dom", "WebSocket XSS", "critical", _ONMESSAGE, (".onmessage",),
       "Raw socket data written to the page", groups=1, fmt="ws.onmessage → DOM sink", **_WS,
       guards=(Guard("value", r"innerHTML|outerHTML|document\.write", True),)),
    _r("ws-json-nocheck", "WebSocket Security", "medium", _ONMESSAGE, (".onmessage",),
       "Socket message parsed without an origin test", groups=1,
       fmt="ws.onmessage → JSON.parse (no origin check)", **_WS,
       guards=(Guard("value", r"JSON\.parse", True), Guard("value", r"origin|source", False))),
    _r("ws-sensitive-emit", "Socket.io Security", "high",
       r"""\.emit\s*\(\s*["']([^"']+)["']\s*(?:,([^)]{0,200}))?\)""", (".emit",),
       "Sensitive data sent over a socket", groups=2, fmt='socket.emit("{v}", {g2})', **_WS,
       guards=(Guard("g2", r"(?i)password|token|secret|auth|key|credential", True),)),
]

_CR = "Cryptographic Risk"
CRYPTO_CONTEXT = [
    _r("crypto-privkey", _CR, "critical",
       r"(?i)(?:privateKey|private_key|privKey|secretKey)\s*[=:]",
       ("privatekey", "private_key", "privkey", "secretkey"), "Secret key used by the client", value_len=80),
    _r("crypto-static-iv", _CR, "high",
       r"""(?i)(?:iv|nonce|salt)\s*[:=]\s*["'][0-9a-fA-F]{16,}["']""", ("iv", "nonce", "salt"),
       "Constant initialisation vector", value_len=80),
    _r("crypto-ecb", _CR, "critical", r"(?i)(?:AES-ECB|mode:\s*CryptoJS\.mode\.ECB)", ("ecb",),
       "Block mode that shows plaintext patterns", value_len=80),
    _r("crypto-det-seed", _CR, "high",
       r"(?i)(?:seed|key|secret)\s*[:=]\s*(?:username|email|userId|Date\.now)",
       ("seed", "key", "secret"), "Seed from predictable data", value_len=80),
    _r("crypto-subtle-noerr", _CR, "medium",
       r"crypto\.subtle\.(?:encrypt|decrypt|sign|verify|importKey)\s*\(", ("crypto.subtle.",),
       "Crypto call without error handling", value_len=80,
       guards=(drop(r".catch\s*\(|try\s*\{", 0, 300),)),
]

INFO_LEAKAGE = [
    _r("leak-stack", "Info Leakage", "high", r"(?:error|err|e)\.stack\b", (".stack",),
       "Stack trace reaches the user",
       guards=(keep(r"(?i)innerHTML|textContent|innerText|response|send|json", 100, 100),)),
    _r("leak-enum", "Info Leakage / IDOR", "medium",
       r"""["'`]/(?:api|rest|v\d+)/[^"'`]*\$\{[^}]*(?:id|Id|ID|num|index)\}""", ("${",),
       "Address with a countable id"),
    _r("leak-debug", "Info Leakage", "medium", r"console\.(log|debug|dir|table)\s*\(",
       ("console.",), "Sensitive data written to the console", groups=1, dedupe="context60",
       value_len=80,
       guards=(keep(r"(?i)token|password|secret|key|auth|session|user|email", 100, 100),)),
    _r("leak-path", "Info Leakage", "low",
       r"""["'][^"']*/(?:src|app|lib|server|backend|node_modules)/[^"']{5,}["']""", ("/",),
       "Internal path in the bundle"),
]

_OWNER = r"(?i)userId\s*===\s*|currentUser|isOwner|checkOwner|verifyOwner"
IDOR = [
    _r("idor-url-id", "IDOR", "high",
       r"""["'`][^"'`]*/\$\{(?:[^}]*\.)?(?:userId|user_id|id|uid|accountId|customerId)[^}]*\}[^"'`]*["'`]""",
       ("/${",), "User id in an address", value_len=120, context=(125, 125),
       downgrade=(_OWNER, "low")),
    _r("idor-qp", "IDOR", "medium", r"[?&](?:id|user_id|userId|account_id|order_id)=\$\{", ("=${",),
       "Record id as a query parameter", value_len=80, context=(125, 125)),
    _r("idor-ls-id", "IDOR", "high",
       r"""localStorage\.getItem\s*\(\s*["'](?:userId|user_id|uid)["']\s*\)""",
       ("localStorage.getItem",), "Stored user id used in a request", value_len=80,
       context=(125, 125), guards=(keep(r"fetch|http\.|axios\.|get\s*\(|post\s*\(", 0, 400),)),
]

_ASYNC = r"(?:async\s+function|async\s*\([^)]*\)\s*=>|async\s+\w+\s*\()[^}]{0,500}localStorage\.(getItem|setItem)"
RACE = [
    _r("race-ls-rw", "Race Condition", "medium", _ASYNC, ("async",),
       "Storage read then write in an asynchronous function", groups=1, context=(125, 125),
       fmt="async read-modify-write on localStorage",
       guards=(Guard("match", r"localStorage\.getItem", True),
               Guard("match", r"localStorage\.setItem", True))),
    _r("race-promise-ls", "Race Condition", "medium",
       r"localStorage\.getItem[^;]{0,200}\.then\s*\([^)]{0,200}localStorage\.setItem",
       ("localStorage.getItem",), "Storage write after an awaited read", context=(125, 125),
       fmt="localStorage read→Promise→write"),
    # fixed pattern: read from storage, at most three statements on, the same name plus one
    _r("race-counter", "Race Condition", "high",
       skip_names(
           r"(\w+)\s*=\s*(?:parseInt\s*\()?\s*localStorage\.getItem[^;]{0,100};\s*"
           r"(?:[^;]{0,100};\s*){0,3}\1\s*(?:\+\+|\+=\s*1|\+\s*1)",
           r"\w\w", unless=r"\s*=\s*(?:parseInt\s*\()?\s*localStorage",
       ),
       ("localStorage.getItem",), "Counter in storage without a lock", groups=1, value="g1",
       fmt="Non-atomic counter: {v}", context=(125, 125)),
]

WEB3 = [
    _r("web3-privkey", "Web3 Security", "critical",
       r"""(?:0x[0-9a-fA-F]{64}|privateKey\s*[:=]\s*["'][^"']{20,}["'])""", ("0x", "privateKey"),
       "Ledger private key", value_len=80),
    _r("web3-sendtx", "Web3 Security", "high", r"eth_sendTransaction|\.sendTransaction\s*\(",
       ("sendTransaction",), "Transaction sent from the client", value_len=80),
    _r("web3-reentrancy", "Web3 Security", "high",
       r"\.call\s*\([^)]*\)\s*\.\s*then\s*\([^)]*\s*=>\s*\{[^}]{0,200}balance", (".call",),
       "Balance touched after an external call"),
    _r("web3-address", "Web3 Security", "info", r"""["']0x[0-9a-fA-F]{40}["']""", ("0x",),
       "Ledger address literal", dedupe="value"),
    _r("web3-sig-replay", "Web3 Security", "high",
       r"(?:ethers|web3)\.utils\.(?:solidityKeccak256|keccak256)\s*\(", (".utils.",),
       "Hash without a nonce or chain id", value_len=80,
       guards=(drop(r"(?i)nonce|chainId|deadline", 100, 100),)),
]

_CFG = "Config Behaviour"
CONFIG_FLAGS = [
    _r("cfg-debug-env", _CFG, "low", r"environment\.production\s*(?:===|==|!==|!=)\s*(?:false|true)",
       ("environment.production",), "Logging switched by the build flag",
       guards=(keep(r"(?i)debug|log|verbose|trace", 100, 100),)),
    _r("cfg-sec-disable", _CFG, "high",
       r"(?i)(?:disableAuth|skipAuth|noAuth|bypassAuth|ignoreSSL|rejectUnauthorized\s*:\s*false|strictSSL\s*:\s*false)",
       ("auth", "ssl"), "Protection switched off", value_len=80),
    _r("cfg-hardcoded-url", _CFG, "info",
       r"""(?i)(?:apiUrl|baseUrl|API_URL|BASE_URL)\s*[:=]\s*["'](https?://[^"']+)["']""", ("url",),
       "Base address literal", groups=1),
    _r("cfg-cors-wildcard", _CFG, "high", r"""(?i)(?:allowedOrigins|cors)\s*[:=]\s*["'][*]["']""",
       ("allowedorigins", "cors"), "Any origin allowed", value_len=80),
]

_LAZY = "Lazy Loading Security"
_LAZY_ROUTE = r"""path\s*:\s*["']([^"']{1,80})["'][^{};]{0,400}?loadChildren\s*:"""
LAZY_LOADING = [
    _r("lazy-unguarded", _LAZY, "high", _LAZY_ROUTE, ("loadChildren",),
       "Sensitive lazy route without a guard", groups=1, value="g1", fmt="/{v}", context=(125, 125),
       guards=(drop(r"canActivate\s*:\s*\[", 0, 400),
               Guard("value", r"(?i)admin|account|payment|order|wallet|secret|internal", True))),
    _r("lazy-chunk-name", _LAZY, "info", _LAZY_ROUTE, ("loadChildren",),
       "Predictable chunk file", groups=1, context=(125, 125),
       extract=(400, r"""/\*\s*webpackChunkName\s*:\s*["']([^"']+)["']\s*\*/""")),
    _r("lazy-dyn-import", _LAZY, "high", r"import\s*\(\s*[A-Za-z_$][A-Za-z0-9_$.]*\s*\)", ("import",),
       "Import path from user data", value_len=80, context=(125, 125),
       guards=(keep(r"(?i)user|input|param|query|data|route", 125, 125),)),
]

_SW = dict(category="Service Worker", context_from="match")
SERVICE_WORKER = [
    Rule("sw-register-relative", "medium",
         pattern=r"""navigator\s*\.\s*serviceWorker\s*\.\s*register\s*\(\s*["']([^"']+)["']""",
         gate=("serviceWorker",), groups=1, value="g1", fmt="SW register: {v}",
         guards=(Guard("value", r"^(?:/|\./|[A-Za-z][A-Za-z0-9+.\-]*://)", False),),
         description="Worker registered by a relative address", **_SW),
    Rule("sw-fetch-intercept", "medium", pattern=r"""addEventListener\s*\(\s*["']fetch["'][^)]*\)""",
         gate=("addEventListener",), fmt="SW fetch listener",
         description="Worker sees every request", **_SW),
    Rule("sw-message", "info", pattern=r"""addEventListener\s*\(\s*["']message["'][^)]*\)""",
         gate=("addEventListener",), fmt="SW message (origin-checked)",
         guards=(Guard("match", r"(origin|source)\s*===?\s*", True),),
         description="Worker message listener", **_SW),
    Rule("sw-message-no-origin", "high", pattern=r"""addEventListener\s*\(\s*["']message["'][^)]*\)""",
         gate=("addEventListener",), fmt="SW message (NO origin check)",
         guards=(Guard("match", r"(origin|source)\s*===?\s*", False),),
         description="Worker message listener without an origin test", **_SW),
    Rule("sw-cache-api", "info", pattern=r"caches\s*\.\s*open\s*\(", gate=("caches",),
         fmt="Cache API: {n} call(s)", dedupe="artifact", description="Worker uses a cache", **_SW),
    Rule("sw-skip-waiting", "info", pattern=r"skipWaiting\s*\(", gate=("skipWaiting",),
         fmt="skipWaiting()", dedupe="artifact", description="Worker takes over at once", **_SW),
    Rule("sw-clients-claim", "info", pattern=r"clients\s*\.\s*claim\s*\(", gate=("clients",),
         fmt="clients.claim()", dedupe="artifact", description="Worker claims open pages", **_SW),
]
# A service-worker script shows at least one of these.
SERVICE_WORKER_SIGNS = r"serviceWorker|self\.addEventListener|caches\.open|skipWaiting|clients\.claim"

_MC = dict(value_len=80, context=(80, 100), trim=True)


def _crypto(rule_id, severity, pattern, gate, text, category="Broken Crypto", groups=0, guards=()):
    return Rule(rule_id, severity, category, pattern, gate, groups=groups,
                value="g1" if groups else "match", guards=guards, description=text, **_MC)


MODERN_CRYPTO = [
    _crypto("crypto-jwt-in-source", "critical",
            r"""["'](eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+)["']""", ("eyJ",),
            "Complete JSON web token", groups=1),
    _crypto("crypto-jwt-partial", "high",
            r"""["'](eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,})["']""", ("eyJ",),
            "Part of a JSON web token", groups=1),
    _crypto("crypto-subtle-import-raw", "critical",
            r"""crypto\.subtle\.importKey\s*\(\s*["']raw["']""", ("crypto.subtle.importKey",),
            "Raw key imported", guards=(drop(r"(?i)test|spec|example", 100, 120),)),
    _crypto("crypto-subtle-export", "high", r"crypto\.subtle\.(exportKey|wrapKey)\s*\(",
            ("crypto.subtle.",), "Key exported", groups=1),
    _crypto("crypto-subtle-no-catch", "medium",
            r"crypto\.subtle\.(encrypt|decrypt|sign|verify|digest)\s*\(", ("crypto.subtle.",),
            "Crypto call without error handling", groups=1,
            guards=(drop(r"\.catch\s*\(|try\s*\{", 100, 120),)),
    _crypto("crypto-bearer-token", "critical", r"""["']Bearer\s+([A-Za-z0-9\-_.]{20,})["']""",
            ("Bearer",), "Bearer token literal", "Hardcoded Credential", 1,
            (drop(r"(?i)example|test|placeholder", 100, 120),)),
    _crypto("crypto-auth-header", "high",
            r"""(?i)Authorization\s*:\s*["'](?:Bearer|Basic|Token)\s+([^"']+)["']""",
            ("authorization",), "Authorization header literal", "Hardcoded Credential", 1),
    _crypto("crypto-node-md5", "high",
            r"""crypto\.create(?:Hash|Hmac)\s*\(\s*["'](?:md5|MD5|sha1|SHA1)["']""",
            ("crypto.create",), "Weak hash"),
    _crypto("crypto-node-createcipher", "critical", r"crypto\.createCipher\s*\(",
            ("crypto.createCipher",), "Cipher without an initialisation vector"),
    _crypto("crypto-bcrypt-hash", "medium",
            r"""bcrypt\.compare\s*\([^,]+,\s*["']\$2[ab]?\$\d{2}\$[^"']+["']""", ("bcrypt.compare",),
            "Password hash literal"),
    _crypto("crypto-jwt-none", "critical",
            r"""(?i)(?:jwt\.verify|jsonwebtoken\.verify)\s*\([^,]+,\s*["']none["']""", (".verify",),
            "Token accepted without a signature"),
    _crypto("crypto-jwt-no-secret", "critical",
            r"""jwt\.(?:sign|verify)\s*\([^,]+,\s*["']\s*["']""", ("jwt.",),
            "Token with an empty secret"),
    _crypto("crypto-math-random-token", "high",
            r"(?i)(?:Math\.random|Math\.floor\s*\(\s*Math\.random\s*\*)\s*[^;]{0,100}(?:token|secret|key|nonce|csrf|session|password)",
            ("math.random",), "Weak random source for a secret"),
    _crypto("crypto-date-token", "high",
            r"(?i)(?:Date\.now|new\s+Date\s*\([^)]*\)\.getTime)\s*[^;]{0,100}(?:token|secret|key|nonce|csrf|session|password)",
            ("date",), "Clock value used as a secret"),
    _crypto("crypto-hardcoded-key", "critical",
            r"""(?:aesKey|aes_key|AES_KEY|encryptionKey)\s*[:=]\s*["'][0-9a-fA-F]{32,}["']""",
            ("aesKey", "aes_key", "AES_KEY", "encryptionKey"), "Cipher key literal"),
    _crypto("crypto-hardcoded-iv", "high",
            r"""(?i)(?:iv|initializationVector|nonce)\s*[:=]\s*["'][0-9a-fA-F]{16,}["']""",
            ("iv", "initializationvector", "nonce"), "Initialisation vector literal",
            guards=(drop(r"(?i)example|placeholder", 100, 120),)),
    _crypto("crypto-ecb-mode", "critical",
            r"(?i)(?:AES-ECB|CryptoJS\.mode\.ECB|aes-128-ecb|aes-256-ecb)", ("ecb",), "Block mode ECB"),
    _crypto("crypto-insecure-random", "medium",
            r"\b(Math\.random\s*\(\s*\)|[^c]random\s*\(\s*\))\s*[*x×]\s*\d+", ("random",),
            "Weak random number", groups=1,
            guards=(keep(r"(?i)token|code|otp|pin|key|secret|nonce", 100, 120),)),
    _crypto("crypto-hex-secret-key", "critical",
            r"""["']([0-9a-fA-F]{64})["']\s*(?:,|;|\s*\))""", ('"', "'"), "64 hexadecimal digits",
            groups=1, guards=(keep(r"(?i)secret|key|private|mnemonic|seed|passphrase", 100, 120),)),
    _crypto("crypto-token-in-source", "high",
            r"""(?i)(?:api_token|api_key|secret_key|app_secret|access_token)\s*=\s*["'][A-Za-z0-9_\-]{16,}["']""",
            ("api_token", "api_key", "secret_key", "app_secret", "access_token"),
            "Token literal", "Credential Leakage",
            guards=(drop(r"(?i)example|test|changeme|your_|placeholder", 100, 120),)),
]
