"""Who is asking: claims of tokens, typed course references, origins that may be linked to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CLAIMS = "iss STRING, typ STRING, token_type STRING, azp STRING, exp DOUBLE, preferred_username STRING, aud STRING"


def claims(token: Column) -> Column:
    """The claims of a token as JSON, unverified; null where it has none."""
    parts = F.split(token, r"\.")
    body = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")))
    return F.when((F.size(parts) == 3) & T.strip(text).startswith("{") & F.get_json_object(text, "$").isNotNull(), text)


def accepted(tokens: DataFrame, *, issuer: str, now: float, audience: str | None = None, clients: tuple[str, ...] = (), username_claim: str = "preferred_username") -> DataFrame:
    """Rows of tokens (``claims`` JSON) that are a user's, with ``username`` and ``client``.

    An ``audience`` is asked for where tokens are introspected. A token that is
    not a bearer's, expired, of another issuer or client, or without a name, goes.
    """
    at = lambda key: F.get_json_object("claims", f"$.{key}")
    bearer = lambda key: at(key).isNull() | (F.lower(at(key)) == "bearer")
    name = T.strip(F.coalesce(at(username_claim), F.lit("")))
    ok = (F.regexp_replace(F.coalesce(at("iss"), F.lit("")), "/+$", "") == issuer.rstrip("/")) & bearer("typ") & bearer("token_type") & (at("exp").try_cast("double") > now) & (name != "")
    if audience is not None:
        listed = F.coalesce(F.from_json(at("aud"), "array<string>"), F.array(at("aud")))
        ok = ok & F.array_contains(listed, audience)
    client = F.coalesce(at("azp"), F.lit(""))
    if clients:
        ok = ok & client.isin(*clients)
    return tokens.filter(F.coalesce(ok, F.lit(False))).withColumns({"username": name, "client": client})


def course_ref(typed: Column) -> Column:
    """What a person means who types a course: a reference, or an address that holds an id."""
    raw = T.strip(typed)
    found = F.regexp_extract(raw, "(?i)([0-9a-f]{32})", 1)
    return F.when(raw.contains(":") & ~raw.startswith("http"), raw).when(found != "", F.concat(F.lit("studip:"), found)).otherwise(raw)


def origin(url: Column) -> Column:
    """Scheme and host of a secure address, null for others."""
    return F.when(url.startswith("https://"), F.array_join(F.slice(F.split(F.regexp_replace(url, "/+$", ""), "/"), 1, 3), "/"))


def origins(urls: DataFrame, order: str = "ord") -> DataFrame:
    """Distinct origins in order of first sight."""
    return urls.select(order, origin(F.col("url")).alias("origin")).filter("origin IS NOT NULL").groupBy("origin").agg(F.min(order).alias(order))


def offered(capabilities: Column, kind: str) -> Column:
    """Whether a service's answer (JSON) lists a capability; an answer that cannot be read lists none."""
    listed = F.from_json(F.get_json_object(capabilities, "$.capabilities"), "array<string>")
    return F.coalesce(F.array_contains(listed, kind), F.lit(False))
