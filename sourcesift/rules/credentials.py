"""Credential rules: secrets, keys, tokens and personal data written into the text."""

from __future__ import annotations

from sourcesift.rules.model import LINE_END, Guard, Rule, span


def _skip(regex: str) -> tuple[Guard, ...]:
    return (Guard("value", regex, keep=False),)


def _rule(slug, name, severity, pattern, gate, value="match", guards=(), description=""):
    return Rule(
        rule_id=slug,
        severity=severity,
        category=name,
        pattern=pattern,
        gate=gate,
        groups=1 if value == "g1" else 0,
        value=value,
        value_len=120,
        min_len=3,
        guards=guards,
        context=(40, 80),
        dedupe="full",
        description=description,
        cwe="CWE-798",
    )


# Names, severities and patterns decide which matches are reported.
CREDENTIALS = [
    _rule("hardcoded-password", "Hardcoded Password", "critical",
          r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*["']([^"']{4,64})["']""",
          ("password", "passwd", "pwd"), "g1",
          _skip(r"(?i)^(?:password|placeholder|\*+|your.password)$"),
          "Password literal assigned in code"),
    _rule("hardcoded-credential", "Hardcoded Credential", "critical",
          r"""(?i)(?:testingUsername|testingPassword|TESTING_CRED)\s*=\s*["']([^"']+)["']""",
          ("testing",), "g1", (), "Test account left in code"),
    _rule("hardcoded-api-key", "Hardcoded API Key", "critical",
          r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*["']([A-Za-z0-9_\-]{20,64})["']""",
          ("api",), "g1", (), "API key literal"),
    _rule("jwt-secret", "JWT Secret", "critical",
          r"""(?i)(?:jwt[_-]?secret|jwtSecret)\s*[:=]\s*["']([^"']{8,})["']""",
          ("jwt",), "g1", (), "Signing secret for JSON web tokens"),
    _rule("google-oauth-client-id", "Google OAuth Client ID", "high",
          r"\d{12,}-[a-z0-9]{32}\.apps\.googleusercontent\.com",
          (".apps.googleusercontent.com",), description="Google OAuth client"),
    _rule("oauth-client-id", "OAuth Client ID", "high",
          r"""(?i)client[_-]?id\s*[:=]\s*["']([^"']{8,128})["']""",
          ("client",), "g1", _skip(r"(?i)placeholder|example|test"), "OAuth client"),
    _rule("localstorage-token", "localStorage token", "high",
          r"""localStorage\.(?:getItem|setItem)\s*\(\s*["']token["']""",
          ("localStorage.",), description="Session token kept in web storage"),
    _rule("cookie-token", "Cookie token", "medium",
          r"""cookieService\.(?:put|get)\s*\(\s*["']token["']""",
          ("cookieService.",), description="Session token handled as a cookie"),
    _rule("btoa-reverse", "Broken Crypto — btoa(reverse)", "critical",
          r"""btoa\s*\(\s*\w+\.split\s*\(\s*["']["']\s*\)\.reverse\s*\(\s*\)\.join\s*\(\s*["']["']\s*\)\s*\)""",
          ("btoa",), description="Reversed base64 is not encryption"),
    _rule("btoa-field-reverse", "Broken Crypto — btoa(field.split.reverse)", "critical",
          r"""(?i)btoa\s*\(\s*[\w.]+(?:email|password|user)\s*(?:\?\.|\.)\s*split\s*\(["']["']\s*\)\s*\.reverse""",
          ("btoa",), description="Account field hidden by reversed base64"),
    _rule("cookie-token-storage", "Cookie token storage", "medium",
          r"""cookieService\.put\s*\(\s*["']token["']""",
          ("cookieService.put",), description="Session token written to a cookie"),
    _rule("weak-random-password", "Weak Entropy — Math.random password", "high",
          span(r"(?i)Math\.random\s*\(\s*\)", ".", "password", lazy=True, stop=r"Math\.random[\s(]*" + LINE_END),
          ("math.random",), description="Password from a weak random source"),
    _rule("private-key", "Private Key", "critical",
          r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
          ("-----BEGIN ",), description="Private key block"),
    _rule("bearer-token", "Bearer Token", "high",
          r"Bearer\s+[A-Za-z0-9\-_.]{20,}",
          ("Bearer",), description="Bearer token"),
    _rule("aws-access-key", "AWS Access Key", "critical",
          r"AKIA[0-9A-Z]{16}", ("AKIA",), description="Cloud access key id"),
    _rule("aws-secret-key", "AWS Secret Key", "critical",
          r"""(?i)aws[_-]?secret[_-]?(?:access[_-]?)?key\s*[:=]\s*["']([^"']{40})["']""",
          ("aws",), "g1", (), "Cloud secret key"),
    _rule("stripe-key", "Stripe Key", "critical",
          r"sk_(?:live|test)_[0-9a-zA-Z]{24}", ("sk_live_", "sk_test_"),
          description="Payment provider key"),
    _rule("sendgrid-api-key", "SendGrid API Key", "critical",
          r"SG\.[a-zA-Z0-9_\-]{22}\.[a-zA-Z0-9_\-]{43}", ("SG.",),
          description="Mail provider key"),
    _rule("github-token", "GitHub Token", "critical",
          r"gh[pousr]_[A-Za-z0-9]{36}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
          description="Code host token"),
    _rule("hardcoded-email", "Hardcoded Email", "medium",
          r"""["'][a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}["']""",
          ("@",), guards=(Guard("value", r"@(?:example\.com|test\.com)", keep=False),
                          Guard("value", r"^[^\n]{81}", keep=False)),
          description="Mail address literal"),
    _rule("internal-ip", "Internal IP", "low",
          r"""["'](?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+["']""",
          ("10.", "172.", "192.168."), description="Private network address"),
    _rule("us-ssn", "US SSN", "critical",
          r"\b\d{3}-\d{2}-\d{4}\b", ("-",), guards=_skip(r"entry\.\d+"),
          description="Social security number format"),
    _rule("hardcoded-coupon-code", "Hardcoded Coupon Code", "high",
          r"\b([A-Z]{4,10}\d{4})\s*:", (":",), "g1", _skip(r"^[^\n]{21}"),
          "Coupon code in a table"),
    _rule("time-gated-discount", "Time-Gated Discount", "medium",
          r"validOn\s*:\s*(\d{10,13})", ("validOn",), "g1", (), "Discount bound to a date"),
    _rule("mongodb-uri", "MongoDB URI", "critical",
          r"""(?i)mongodb(?:\+srv)?://[^"'\s]+""", ("mongodb",),
          description="Database connection text"),
    _rule("database-password", "Database password", "critical",
          r"""(?i)db[_-]?pass(?:word)?\s*[:=]\s*["']([^"']+)["']""", ("pass",), "g1", (),
          "Database password literal"),
    _rule("smtp-credentials", "SMTP credentials", "high",
          r"""(?i)smtp[_-]?(?:pass|password|user|username)\s*[:=]\s*["']([^"']+)["']""",
          ("smtp",), "g1", (), "Mail server login"),
    _rule("slack-token", "Slack Token", "critical",
          r"xox[baprs]-[0-9a-zA-Z]{10,48}", ("xox",), description="Chat workspace token"),
    _rule("base64-secret-candidate", "Base64 secret candidate", "low",
          r"""["'][A-Za-z0-9+/]{40,}={0,2}["']""", ('"', "'"), guards=_skip(r"^[^\n]{201}"),
          description="Long base64 literal"),
    _rule("hex-secret-candidate", "Hex secret candidate", "low",
          r"""["'][0-9a-fA-F]{40,}["']""", ('"', "'"), guards=_skip(r"^[^\n]{81}"),
          description="Long hexadecimal literal"),
]
