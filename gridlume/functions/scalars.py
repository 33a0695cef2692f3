"""Numbers, dates, durations, digests and requests as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlume.functions.text import trim



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DATE = r"^([0-9]{2})/([0-9]{2})/([0-9]{4}) ([0-9]{2}):([0-9]{2})$"


def js_number(c: Column) -> Column:
    """A text read as a number; blank, unreadable, infinite and null texts are 0."""
    t = trim(c.cast("string"))
    value = F.when(F.rlike(t, F.lit(_DECIMAL)), t.try_cast("double"))
    for base, mark, digits in ((16, "xX", "0-9a-fA-F"), (8, "oO", "0-7"), (2, "bB", "01")):
        value = value.when(F.rlike(t, F.lit(f"^0[{mark}][{digits}]+$")), _whole_number(F.substring(t, 3, 1 << 20), base))
    return F.coalesce(F.when(F.abs(value) < float("inf"), value), F.lit(0.0))


def _whole_number(digits: Column, base: int) -> Column:
    """The double nearest to a whole number in base 2, 8 or 16.

    The first 60 bits decide, the last of them set if any digit after them is: then the cast rounds as all digits would.
    """
    width = {2: 1, 8: 3, 16: 4}[base]
    take = 60 // width
    bare = F.regexp_replace(digits, "^0+", "")
    rest = F.when(F.rlike(F.substring(bare, take + 1, 1 << 20), F.lit("[^0]")), 1).otherwise(0)
    head = F.coalesce(F.conv(F.substring(bare, 1, take), base, 10).cast("long"), F.lit(0)).bitwiseOR(rest.cast("long"))
    return head.cast("double") * F.pow(F.lit(2.0), F.greatest(F.length(bare) - take, F.lit(0)) * width)


def french_millis(c: Column) -> Column:
    """Milliseconds of a ``dd/MM/yyyy HH:mm`` text in UTC; days and months roll over, other texts are 0."""
    # digits stand at fixed places of a text that matches
    t = F.when(F.rlike(c, F.lit(_DATE)), c)
    part = lambda at, n=2: F.substring(t, at, n).try_cast("int")
    year = F.when(part(7, 4) < 100, part(7, 4) + 1900).otherwise(part(7, 4))
    day = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), part(4) - 1), part(1) - 1)
    return F.coalesce(F.unix_date(day).cast("long") * 86_400_000 + part(12) * 3_600_000 + part(15) * 60_000, F.lit(0)).cast("long")


def earliest(value: Column, seq: Column) -> Column:
    """Aggregate: the non-empty text of least date, the first of equals; empty if there is none."""
    some = F.nullif(value, F.lit(""))
    return F.coalesce(F.min_by(some, F.when(some.isNotNull(), F.struct(french_millis(some), seq))), F.lit(""))


def latest(value: Column, seq: Column) -> Column:
    """Aggregate: the non-empty text of greatest date, the first of equals."""
    some = F.nullif(value, F.lit(""))
    return F.coalesce(F.min_by(some, F.when(some.isNotNull(), F.struct(-french_millis(some), seq))), F.lit(""))


def duration_seconds(c: Column, fallback: float) -> Column:
    """Seconds of ``250ms``, ``0.5s``, ``15m``, ``2h``, ``7d`` or a bare number; anything else gives the fallback."""
    pattern = r"^([0-9]+(?:\.[0-9]+)?)(ms|s|m|h|d)?$"
    t = trim(c)
    number, unit = F.regexp_extract(t, pattern, 1).try_cast("double"), F.regexp_extract(t, pattern, 2)
    scale = F.when(unit == "ms", 0.001).when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0).otherwise(1.0)
    return F.coalesce(number * scale, F.lit(float(fallback)))


def fixed(c: Column, digits: int, even: bool = False) -> Column:
    """Fixed decimals of the exact binary value, halves away from zero, or to ``even`` as printf has it (up to nine digits before the point).

    The scaled value is kept as a rounded product and its exact error (Dekker's splitting), so 0.15 with one digit is 0.1:
    its binary value lies below the half.
    """
    return let(c.cast("double"), lambda v: _fixed(v, digits, even))


def _fixed(c: Column, digits: int, even: bool) -> Column:
    x, scale = F.abs(c), float(10**digits)
    product = x * scale
    split = x * 134217729.0
    high = split - (split - x)
    low = x - high
    error = (high * scale - product) + low * scale  # the scale is a short number, so both products are exact
    down = F.floor(product)
    rest = product - down
    up = (error > 0) | ((error == 0) & (down % 2 == 1)) if even else error >= 0
    n = down + F.when((rest > 0.5) | ((rest == 0.5) & up), 1).otherwise(0)
    unit = F.lit(10**digits).cast("long")
    whole = F.floor(n / unit).cast("long") if digits else n
    text = F.concat(whole.cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0")) if digits else n.cast("string")
    return F.when(c < 0, F.concat(F.lit("-"), text)).otherwise(text)  # also where all digits round to 0


def locale_sorted(values: Column) -> Column:
    """An array of texts in language-aware order (root locale), as names are shown: case and accents decide last."""
    return F.array_sort(values.cast("array<string collate UNICODE>")).cast("array<string>")


def digest_key(values: Column) -> Column:
    """SHA-256 of the JSON text of the distinct non-empty values in language-aware order."""
    return F.sha2(F.to_json(locale_sorted(F.array_distinct(F.filter(values, lambda v: v != "")))), 256)


def request_key(method: Column, url: Column, body: Column) -> Column:
    """The default key under which equal requests are one."""
    return F.concat_ws(":", F.coalesce(method, F.lit("GET")), url, F.coalesce(body, F.lit("")))


def query_url(base: Column, parameters: list[tuple[str, Column]]) -> Column:
    """Base address and form-encoded parameters, in order; null values are left out."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in parameters]
    return F.concat_ws("?", base, F.nullif(F.concat_ws("&", *pairs), F.lit("")))


def french_time(c: Column) -> Column:
    """``dd/MM HH:mm`` of an ISO instant, a dash if it cannot be read."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.nullif(c, F.lit(""))), "dd/MM HH:mm"), F.lit("-"))


def within_bytes(body: Column, limit: int) -> Column:
    """Whether a body is no longer than the limit (equal is allowed)."""
    return F.octet_length(body) <= limit


# Kind of failure, its public code, its HTTP status.
ERRORS = (
    ("InvalidViewport", "INVALID_VIEWPORT", 400),
    ("ViewportTooLarge", "VIEWPORT_TOO_LARGE", 400),
    ("TooManyCommunes", "TOO_MANY_COMMUNES", 400),
    ("MethodNotAllowed", "METHOD_NOT_ALLOWED", 405),
    ("RouteNotFound", "NOT_FOUND", 404),
    ("PayloadTooLarge", "PAYLOAD_TOO_LARGE", 413),
    ("InvalidRequest", "INVALID_REQUEST", 400),
    ("InvalidCursor", "INVALID_CURSOR", 400),
    ("CursorExpired", "CURSOR_EXPIRED", 410),
    ("VerificationRequired", "VERIFICATION_REQUIRED", 401),
    ("VerificationFailed", "VERIFICATION_FAILED", 403),
    ("RateLimitExceeded", "RATE_LIMITED", 429),
    ("UpstreamTransportError", "UPSTREAM_TRANSPORT_ERROR", 502),
    ("UpstreamStatusError", "UPSTREAM_STATUS_ERROR", 502),
    ("UpstreamDecodeError", "UPSTREAM_DECODE_ERROR", 502),
    ("CryptoError", "INTERNAL_ERROR", 500),
)

# French sentence of each public code.
ERROR_SENTENCES = {
    "INVALID_VIEWPORT": "La zone affichée est invalide.",
    "VIEWPORT_TOO_LARGE": "Zoomez davantage pour afficher les coupures.",
    "TOO_MANY_COMMUNES": "La zone affichée contient trop de communes. Zoomez davantage.",
    "METHOD_NOT_ALLOWED": "Cette action n'est pas autorisée.",
    "NOT_FOUND": "Le service demandé est introuvable.",
    "PAYLOAD_TOO_LARGE": "La requête envoyée est trop volumineuse.",
    "INVALID_REQUEST": "La requête envoyée est invalide.",
    "INVALID_CURSOR": "La pagination des résultats est invalide. Rechargez la carte.",
    "CURSOR_EXPIRED": "Les résultats ont expiré. Rechargez la carte.",
    "VERIFICATION_REQUIRED": "Une vérification humaine est requise.",
    "VERIFICATION_FAILED": "La vérification humaine a échoué. Réessayez.",
    "RATE_LIMITED": "Trop de requêtes ont été envoyées. Patientez un instant avant de réessayer.",
    "UPSTREAM_TRANSPORT_ERROR": "Un service de données est temporairement inaccessible.",
    "UPSTREAM_STATUS_ERROR": "Un service de données est temporairement indisponible.",
    "UPSTREAM_DECODE_ERROR": "Un service de données a renvoyé une réponse invalide.",
    "INTERNAL_ERROR": "Une erreur interne est survenue. Réessayez plus tard.",
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def error_code(kind: Column) -> Column:
    """Public code of a failure kind; unknown kinds are internal."""
    return F.coalesce(F.try_element_at(_map({k: c for k, c, _ in ERRORS}), kind), F.lit("INTERNAL_ERROR"))


def error_status(kind: Column) -> Column:
    """HTTP status of a failure kind; unknown kinds are internal."""
    return F.coalesce(F.try_element_at(_map({k: s for k, _, s in ERRORS}), kind), F.lit(500))


def error_sentence(code: Column, status: Column) -> Column:
    """French sentence of a public code, else one with the status."""
    other = F.concat(F.lit("La requête a échoué (HTTP "), status.cast("string"), F.lit(")."))
    return F.coalesce(F.try_element_at(_map(ERROR_SENTENCES), code), other)


def upstream_message(kind: Column, provider: Column, status: Column) -> Column:
    """What went wrong with an upstream read."""
    return (
        F.when(kind == "UpstreamTransportError", F.concat(provider, F.lit(" transport failed")))
        .when(kind == "UpstreamStatusError", F.concat(provider, F.lit(" returned HTTP "), status.cast("string")))
        .when(kind == "UpstreamDecodeError", F.concat(provider, F.lit(" returned an invalid response")))
    )
