"""What kind of answer a fetch got: content, challenge, rate limit or soft block. Labels only, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import contains_any

# Markers in order of precedence.
CAPTCHA = {
    "turnstile": ["challenges.cloudflare.com/turnstile/v0/api.js", "cf-turnstile"],
    "hcaptcha": ["js.hcaptcha.com/1/api.js", "hcaptcha.com/captcha", "h-captcha"],
    "recaptcha": ["www.google.com/recaptcha/api.js", "www.gstatic.com/recaptcha", "g-recaptcha"],
}
CHALLENGE = ["_cf_chl_opt", "/cdn-cgi/challenge-platform/", "challenges.cloudflare.com", "just a moment", "checking your browser", "cf-browser-verification"]
CHALLENGE_2 = ["geo.captcha-delivery.com", "datadome"]
SOFT_PHRASES = ["please enable javascript", "enable javascript", "access denied", "pardon our interruption", "attention required"]
SOFT_TITLES = ["access denied", "attention required", "just a moment"]


def header(headers: Column, name: str) -> Column:
    """A header's value whatever the case of its name; null without headers."""
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.try_element_at(lowered, F.lit(name))


def visible_length(body: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(body, r"(?si)<script\b[^>]*>.*?</script>", ""), r"(?si)<style\b[^>]*>.*?</style>", "")
    bare = F.regexp_replace(bare, "<[^>]*>", "")
    return F.length(F.regexp_replace(bare, r"\s+", ""))


def classify(status: Column, body: Column, url: Column, headers: Column | None = None, least_text: int = 200) -> Column:
    """captcha:<kind>, js_challenge:<vendor>, waf_403, rate_limited, soft_block or real_content; the first that fits. Nulls count as empty."""
    low = F.lower(F.coalesce(body, F.lit("")))
    where = F.lower(F.coalesce(url, F.lit("")))
    head = (lambda n: header(headers, n)) if headers is not None else (lambda n: F.lit(None).cast("string"))
    title = F.regexp_extract(low, r"(?s)<title[^>]*>(.*?)</title>", 1)
    out = F.when(F.lit(False), F.lit(""))
    for kind, markers in CAPTCHA.items():
        out = out.when(contains_any(low, markers), f"captcha:{kind}")
    first = F.coalesce(F.contains(F.lower(head("cf-mitigated")), F.lit("challenge")), F.lit(False)) | contains_any(low, CHALLENGE) | contains_any(where, CHALLENGE)
    second = head("x-datadome").isNotNull() | head("x-datadome-cid").isNotNull() | F.coalesce(F.contains(F.lower(head("set-cookie")), F.lit("datadome")), F.lit(False)) | contains_any(low, CHALLENGE_2)
    waf = F.coalesce(F.contains(F.lower(head("server")), F.lit("cloudflare")), F.lit(False)) | head("cf-ray").isNotNull() | head("x-datadome").isNotNull()
    thin = (status == 200) & (visible_length(F.coalesce(body, F.lit(""))) < least_text) & ~F.contains(low, F.lit("<script")) & (F.octet_length(low) < 5000)
    soft = contains_any(low, SOFT_PHRASES) | contains_any(title, SOFT_TITLES) | F.coalesce(status.between(400, 599), F.lit(False)) | F.coalesce(thin, F.lit(False))
    return out.when(first, "js_challenge:cloudflare").when(second, "js_challenge:datadome").when((status == 403) & waf, "waf_403").when(status == 429, "rate_limited").when(soft, "soft_block").otherwise("real_content")


def retry_after(value: Column, now: Column, default: int = 30) -> Column:
    """Seconds to wait: a number, the distance to an HTTP date (0 if past), else the default."""
    number = F.trim(value).try_cast("long")
    at = F.try_to_timestamp(F.regexp_replace(F.trim(value), "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.coalesce(F.when(number >= 0, number), F.when(at.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(at) - F.unix_timestamp(now))), F.lit(default))


def signed_in(url: Column, headers: Column) -> Column:
    """Whether a request carries personal access: user info in the URL, an authorisation header, or a session cookie."""
    return url.rlike(r"^[a-z]+://[^/@]+@") | header(headers, "authorization").isNotNull() | F.coalesce(header(headers, "cookie").rlike(r"(?i)(?:session|auth|token|jwt|sid)[^=;]*="), F.lit(False))


def outcome(status: Column) -> Column:
    """ok, rate_limited or blocked by status alone."""
    return F.when(status == 429, "rate_limited").when(status >= 400, "blocked").otherwise("ok")
