"""Feeds of linked pages: which records a feed holds, or the first thing that spoils it.

A page names the next one. All feeds are followed at once by pointer doubling: after k rounds every page knows
the page 2^k further on, and every feed the pages of its first 2^k places, so that the rounds grow with the logarithm
of the longest feed allowed and not with its length. A page at two places is a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.operators.dims import universe_bucket
from slotwise.sources.folders import kept

# The members of a ticker record with their types, and the longest symbol in bytes.
MEMBERS = {"ticker": "STRING", "active": "BOOLEAN", "market": "STRING", "locale": "STRING", "type": "STRING"}
LONGEST_SYMBOL = 64
PAGE = "status string, count string, next_url string, results array<string>"


def followed(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """feed, url and place (from 0) of the pages that each feed reaches within ``most`` steps and one more, and the url itself where no page is.

    ``links`` have url and next, ``starts`` feed and url.
    """
    ahead = kept(links.where("next is not null").select("url", "next"), "links")
    reached = kept(starts.select("feed", "url", F.lit(0).cast("bigint").alias("place")), "reached")
    step = 1
    while step <= most:
        jumped = reached.join(ahead, "url").select("feed", F.col("next").alias("url"), (F.col("place") + step).alias("place"))
        reached = kept(reached.unionByName(jumped), "reached")
        further = ahead.select(F.col("url").alias("next"), F.col("next").alias("_after"))
        ahead = kept(ahead.join(further, "next").select("url", F.col("_after").alias("next")), "links")
        step *= 2
    return reached.where(F.col("place") <= most)


def ticker(record: Column) -> Column:
    """A record as a struct with exact types; null where a member is missing, given twice or of another type."""
    parsed = F.try_parse_json(record)
    typed = F.lit(True)
    for name, kind in MEMBERS.items():
        typed = typed & (F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == kind)
    fields = [F.try_variant_get(parsed, f"$.{name}", kind.lower()).alias(name) for name, kind in MEMBERS.items()]
    return F.when(F.coalesce(typed, F.lit(False)), F.struct(*fields))


def ticker_feeds(pages: DataFrame, starts: DataFrame, most_pages: int = 100, most_records: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The records of sound feeds (feed, place, ordinal, ticker, bucket), and feed and error of all feeds ('' if sound).

    ``pages`` have url and body, ``starts`` feed and url. The error is the first that reading page after page would meet.
    """
    decoded = kept(pages.select("url", F.from_json("body", PAGE, {"mode": "PERMISSIVE"}).alias("p")), "pages")
    places = kept(followed(decoded.select("url", F.col("p.next_url").alias("next")), starts, most_pages), "places")
    again = F.row_number().over(Window.partitionBy("feed", "url").orderBy("place"))
    visits = places.withColumn("visit", again).join(decoded, "url", "left")
    size = F.size("p.results")
    # What a page itself can be wrong in, in the order in which a reader would notice.
    wrong = (
        F.when(F.col("place") >= most_pages, F.struct(F.lit(0).alias("phase"), F.lit("too_many_pages").alias("error")))
        .when(F.col("visit") > 1, F.struct(F.lit(1).alias("phase"), F.lit("pagination_cycle").alias("error")))
        .when(F.col("p").isNull(), F.struct(F.lit(2).alias("phase"), F.lit("missing_page").alias("error")))
        .when(F.coalesce(F.col("p.status") != "OK", F.lit(False)) | F.col("p.results").isNull() | (size == 0) | F.coalesce(F.col("p.count") != size.cast("string"), F.lit(False)), F.struct(F.lit(3).alias("phase"), F.lit("malformed_page").alias("error")))
        .when(F.exists(F.transform("p.results", ticker), lambda t: t.isNull()), F.struct(F.lit(3).alias("phase"), F.lit("malformed_record").alias("error")))
        .when(size > most_records, F.struct(F.lit(4).alias("phase"), F.lit("too_many_records").alias("error")))
    )
    judged = visits.select("feed", "place", "p", wrong.alias("wrong"))
    on_pages = judged.where("wrong is not null").select("feed", "place", F.col("wrong.phase").alias("phase"), F.lit(0).alias("ordinal"), F.col("wrong.error").alias("error"))
    records = judged.where("wrong is null").select("feed", "place", F.posexplode("p.results").alias("ordinal", "record")).select("feed", "place", "ordinal", ticker(F.col("record")).alias("t")).select("feed", "place", "ordinal", "t.*")
    bad = F.when(~F.octet_length("ticker").between(1, LONGEST_SYMBOL), "ticker_identity")
    turn = F.row_number().over(Window.partitionBy("feed", "ticker").orderBy("place", "ordinal"))
    in_records = records.withColumn("turn", turn).withColumn("error", F.coalesce(bad, F.when(F.col("turn") > 1, "duplicate_ticker")))
    errors = on_pages.unionByName(in_records.where("error is not null").select("feed", "place", F.lit(5).alias("phase"), "ordinal", "error"))
    first = errors.groupBy("feed").agg(F.min(F.struct("place", "phase", "ordinal", "error")).alias("first"))
    eligible = records.withColumn("bucket", universe_bucket())
    some = eligible.where("bucket = 'eligible'").select("feed").distinct().withColumn("some", F.lit(True))
    verdicts = starts.select("feed").distinct().join(first, "feed", "left").join(some, "feed", "left").select(
        "feed", F.coalesce("first.error", F.when(F.col("some").isNull(), "empty_universe"), F.lit("")).alias("error")
    )
    sound = eligible.join(verdicts.where("error = ''").select("feed"), "feed", "left_semi")
    return sound.select("feed", "place", "ordinal", "ticker", "bucket"), verdicts
