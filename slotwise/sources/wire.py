"""Wire formats: frames of mixed messages and pages of historical bars, decoded with explicit schemas.

A frame is a JSON array of elements. Each is classified on its own. What is no object, names no single
family, or is a bar without one sound symbol makes the rest of its frame ambiguous, so that only what precedes
it is used; an element that repeats a member its family knows is refused alone. Refused rows stay in the output
with a reason, because a refused bar is evidence too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.scalars import exact_integer, finite, finite_positive, floor_ratio, is_plain_decimal, unsigned_zero
from slotwise.operators.bars import reject_reason

LONG_TEXT = {"mode": "PERMISSIVE"}

# The members that each family knows, and the bounds of symbols, trade ids and prices.
MEMBERS = {
    "A": ("s", "e", "o", "h", "l", "c", "dv", "v", "vw", "z"),
    "T": ("sym", "x", "i", "p", "s", "ds", "c", "pt", "t", "q", "z", "trfi", "trft", "e"),
    "Q": ("sym", "t", "bx", "ax", "bp", "ap", "bs", "as", "c", "i", "q", "z"),
    "status": ("status",),
}
LONGEST_SYMBOL = 64
LONGEST_TRADE_ID = 128
HIGHEST_PRICE = 1e9


def _sound_symbol(symbol: Column) -> Column:
    return F.coalesce(F.octet_length(symbol).between(1, LONGEST_SYMBOL), F.lit(False))


def elements(frames: DataFrame) -> DataFrame:
    """epoch, frame, received_s and payload (a JSON array) -> one row per element before the first ambiguous one.

    ``repeated``: it has a member of its family twice.
    """

    def among(keys: Column, names: tuple[str, ...]) -> Column:
        return F.filter(keys, lambda k: k.isin(*names))

    def times(keys: Column, name: str) -> Column:
        return F.size(among(keys, (name,)))

    def ambiguous(element: Column) -> Column:
        keys, symbol = F.json_object_keys(element), F.get_json_object(element, "$.sym")
        unnamed = (F.get_json_object(element, "$.ev") == "A") & ((times(keys, "sym") != 1) | ~_sound_symbol(symbol))
        return keys.isNull() | (times(keys, "ev") != 1) | F.coalesce(unnamed, F.lit(False))

    parts = F.from_json("payload", "array<string>", LONG_TEXT)
    parsed = frames.select("epoch", "frame", "received_s", parts.alias("parts"))
    # The fence is found within the array, so that no frame is shuffled.
    fence = F.array_position(F.transform("parts", ambiguous), True)
    kept = F.when(fence > 0, F.slice("parts", F.lit(1), fence.cast("int") - 1)).otherwise(F.col("parts"))
    rows = parsed.select("epoch", "frame", "received_s", F.posexplode(kept).alias("idx", "element"))
    family, keys = F.get_json_object("element", "$.ev"), F.json_object_keys("element")
    repeated = F.lit(False)
    for name, known in MEMBERS.items():
        mine = among(keys, known)
        repeated = F.when(family == name, F.size(mine) != F.size(F.array_distinct(mine))).otherwise(repeated)
    return rows.select("epoch", "frame", "idx", "received_s", family.alias("family"), F.get_json_object("element", "$.sym").alias("symbol"), repeated.alias("repeated"), "element")


def _decoded(rows: DataFrame, family: str) -> DataFrame:
    """Elements of a family with its members as texts in ``m``, parsed once."""
    members = ", ".join(f"`{m}` string" for m in MEMBERS[family])
    return rows.where(F.col("family") == family).withColumn("m", F.from_json("element", members, LONG_TEXT))


def _text(name: str) -> Column:
    return F.col(f"m.{name}")


def _double(name: str) -> Column:
    return unsigned_zero(_text(name).try_cast("double"))


def _position() -> Column:
    return F.struct("epoch", "frame", "idx").alias("position")


REPEATED = "duplicate_recognized_member"


def live_bars(rows: DataFrame, session_start: int, session_end: int) -> DataFrame:
    """Elements of family A as bars with a reason for those refused; a decimal string of volume wins."""
    text = _text("dv")
    volume = F.when(text.isNull(), _double("v")).when(is_plain_decimal(text), text.try_cast("double"))
    start_ms, end_ms = exact_integer(_text("s")), exact_integer(_text("e"))
    parsed = _decoded(rows, "A").select(
        "symbol", "repeated", _position(), "received_s", start_ms.alias("start_ms"), end_ms.alias("end_ms"),
        _double("o").alias("open"), _double("h").alias("high"), _double("l").alias("low"), _double("c").alias("close"),
        volume.alias("volume"), _double("vw").alias("vwap"), exact_integer(_text("z")).alias("ats"),
    )
    slot, end = F.floor(F.col("start_ms") / 1000), F.floor(F.col("end_ms") / 1000)
    whole = (F.col("start_ms") % 1000 == 0) & (F.col("end_ms") % 1000 == 0)
    reason = F.when(F.col("repeated"), REPEATED).when(~F.coalesce(whole, F.lit(False)), "timestamp").otherwise(
        reject_reason(slot, end, F.lit(session_start), F.lit(session_end))
    )
    return parsed.select("symbol", slot.alias("slot"), "position", "received_s", "open", "high", "low", "close", "volume", "vwap", "ats", reason.alias("reject"))


def trades(rows: DataFrame, session_start: int, session_end: int, ahead_ms: int = 250) -> DataFrame:
    """Elements of family T: identity, size, the earlier of participant and SIP time, lifecycle."""
    def valid(ms: Column) -> Column:
        return ms.isNotNull() & (ms >= session_start * 1000) & (ms < session_end * 1000) & (ms <= F.col("received_s") * 1000 + ahead_ms)

    pt, sip = exact_integer(_text("pt")), exact_integer(_text("t"))
    size, text = exact_integer(_text("s")).cast("double"), _text("ds")
    # Without a decimal size, a size of nothing is none.
    exact = F.when(text.isNull(), F.when(size > 0, size)).when(is_plain_decimal(text) & (F.floor(text.try_cast("double")) == size), text.try_cast("double"))
    parsed = _decoded(rows, "T").select(
        "symbol", "repeated", _position(), "received_s", _text("i").alias("trade_id"), exact_integer(_text("x")).alias("exchange"),
        exact_integer(_text("trfi")).alias("trf_id"), exact_integer(_text("trft")).alias("trf_time"), (_text("trfi").isNotNull() | _text("trft").isNotNull()).alias("trf_named"),
        _double("p").alias("price"), exact.alias("size"), pt.alias("pt"), sip.alias("sip"),
        F.array_sort(F.coalesce(F.from_json(_text("c"), "array<bigint>"), F.array().cast("array<bigint>"))).alias("conditions"), _text("e").alias("lifecycle_mark"),
    )
    from_pt = valid(F.col("pt")) & (~valid(F.col("sip")) | (F.col("pt") <= F.col("sip")))
    event = F.when(from_pt, F.col("pt")).when(valid(F.col("sip")), F.col("sip"))
    identity = _sound_symbol(F.col("symbol")) & (F.col("exchange") > 0) & F.octet_length("trade_id").between(1, LONGEST_TRADE_ID) & finite_positive(F.col("price")) & (F.col("price") <= HIGHEST_PRICE)
    reason = (
        F.when(F.col("repeated"), REPEATED)
        .when(~F.coalesce(identity, F.lit(False)), "trade_identity")
        .when(~finite(F.col("size")) | (F.col("size") < 0), "size")
        .when(event.isNull(), "event_time")
        .when(F.size("conditions") > 16, "conditions")
    )
    basis = F.when(from_pt, "participant").when(event.isNotNull(), "sip_fallback")
    lifecycle = F.when(F.col("lifecycle_mark").isNull(), "original").otherwise("unsupported_lifecycle")
    classified = ~F.col("trf_named") | F.coalesce((F.col("trf_id") > 0) & (F.col("trf_time") > 0), F.lit(False))
    return parsed.select("*", event.alias("event_ms"), basis.alias("basis"), lifecycle.alias("lifecycle"), classified.alias("identity_classified"), reason.alias("reject")).drop("repeated", "trf_named")


def quotes(rows: DataFrame, session_start: int, session_end: int, ahead_ms: int = 250) -> DataFrame:
    """Elements of family Q: one side at least; a side that is given must have a price of at most a billion."""
    sip = exact_integer(_text("t"))
    price = lambda c: F.when(finite_positive(c) & (c <= HIGHEST_PRICE), c)
    side = lambda name: (_text(name).isNotNull() & price(_double(name)).isNull())
    parsed = _decoded(rows, "Q").select(
        "symbol", "repeated", _position(), "received_s", sip.alias("sip"), price(_double("bp")).alias("bid"), price(_double("ap")).alias("ask"), (side("bp") | side("ap")).alias("odd")
    )
    timely = (F.col("sip") >= session_start * 1000) & (F.col("sip") < session_end * 1000) & (F.col("sip") <= F.col("received_s") * 1000 + ahead_ms)
    reason = (
        F.when(F.col("repeated"), REPEATED)
        .when(~_sound_symbol(F.col("symbol")), "symbol")
        .when(~F.coalesce(timely, F.lit(False)), "event_time")
        .when(F.col("odd"), "quote_price")
        .when(F.col("bid").isNull() & F.col("ask").isNull(), "no_side")
    )
    return parsed.withColumn("reject", reason).drop("odd", "repeated")


def statuses(rows: DataFrame) -> DataFrame:
    status = F.get_json_object("element", "$.status")
    phase = F.when(status == "connected", "connected").when(status == "auth_success", "authenticated").when(status == "success", "subscribed").when(status.isin("auth_failed", "error"), "failed").otherwise("other")
    return rows.where("family = 'status'").select("epoch", "frame", "idx", F.when(F.col("repeated"), "other").otherwise(phase).alias("phase"))


BAR_PAGE = "adjusted boolean, status string, ticker string, resultsCount bigint, results array<struct<t:string,o:double,h:double,l:double,c:double,v:double,vw:double,n:string>>"


def historical_bars(pages: DataFrame, session_start: int, session_end: int) -> DataFrame:
    """Pages (symbol, body, and page where a symbol has several) of unadjusted bars.

    One bad row, one that does not come after the one before, or a wrong envelope fails the symbol.
    """
    numbered = pages if "page" in pages.columns else pages.withColumn("page", F.lit(0))
    envelope = numbered.withColumn("e", F.from_json("body", BAR_PAGE, LONG_TEXT))
    sound = (F.col("e.status") == "OK") & ~F.coalesce("e.adjusted", F.lit(True)) & (F.col("e.ticker") == F.col("symbol")) & (F.coalesce("e.resultsCount", F.lit(-1)) == F.size(F.coalesce("e.results", F.array().cast("array<struct<t:string,o:double,h:double,l:double,c:double,v:double,vw:double,n:string>>"))))
    rows = envelope.select("symbol", "page", F.coalesce(sound, F.lit(False)).alias("sound"), F.posexplode_outer("e.results").alias("ordinal", "r"))
    ms, n = exact_integer(F.col("r.t")), exact_integer(F.col("r.n"))
    parsed = rows.select(
        "symbol", "page", "sound", "ordinal", F.floor(ms / 1000).alias("slot"), (ms % 1000 == 0).alias("whole"), n.alias("n"),
        *(unsigned_zero(F.col(f"r.{k}")).alias(v) for k, v in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("vw", "vwap"))),
    ).withColumn("ats", F.when(F.col("n") > 0, floor_ratio(F.col("volume"), F.col("n"))))
    reason = F.when(~F.col("sound"), "envelope").when(F.col("ordinal").isNull(), F.lit(None)).when(~F.coalesce("whole", F.lit(False)), "timestamp").when(F.coalesce("n", F.lit(0)) <= 0, "numeric_count").otherwise(
        reject_reason(F.col("slot"), F.col("slot") + 1, F.lit(session_start), F.lit(session_end))
    )
    judged = parsed.withColumn("reject", reason)
    # Rows must ascend, within a page and from one page to the next, so that none is given twice either.
    before = F.lag("slot").over(Window.partitionBy("symbol").orderBy("page", "ordinal"))
    ordered = judged.withColumn("reject", F.coalesce("reject", F.when(before >= F.col("slot"), "interval_order")))
    failed = ordered.where("reject is not null").select("symbol").distinct()
    good = judged.where("ordinal is not null").join(failed, "symbol", "left_anti")
    return good.select("symbol", "slot", "page", "ordinal", "open", "high", "low", "close", "volume", "vwap", "ats")
