"""Landed venue JSON to typed rows: quotes, markets and payouts.

Each job takes (venue, payload) rows, parses every shape in one pass and adds
`reject_reason`; rows with a reason go to quarantine and are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurmill.functions import exprs as X

LEVEL = "struct<price:string,size:string>"
BOOK = f"struct<bids:array<{LEVEL}>,asks:array<{LEVEL}>>"
LADDERS = "struct<yes_dollars:array<array<string>>,no_dollars:array<array<string>>,yes:array<array<string>>,no:array<array<string>>>"
TWO_BID = ("struct<market:struct<yes_bid_dollars:string,yes_ask_dollars:string,last_price_dollars:string,yes_bid_size_fp:string,"
           f"yes_ask_size_fp:string,open_interest_fp:string,status:string>,orderbook_fp:{LADDERS},orderbook:{LADDERS}>")
TWO_BID_VENUE = "kalshi"


def number(x: Column) -> Column:
    return x.try_cast("double")


def _levels(raw: Column, price, size) -> Column:
    """Array of (price, size) doubles; unreadable levels dropped."""
    read = F.transform(raw, lambda e: F.struct(number(price(e)).alias("price"), number(size(e)).alias("size")))
    return F.filter(read, lambda e: e["price"].isNotNull() & e["size"].isNotNull())


def _ladder(levels: Column, best_first_desc: bool, n: int | None) -> Column:
    key = (lambda e: -e["price"]) if best_first_desc else (lambda e: e["price"])
    keyed = F.array_sort(F.transform(levels, lambda e: F.struct(key(e).alias("k"), e["price"].alias("price"), e["size"].alias("size"))))
    return F.transform(keyed if n is None else F.slice(keyed, 1, n), lambda e: F.struct(e["price"].alias("price"), e["size"].alias("size")))


def _depth(levels: Column, best: Column) -> Column:
    at_best = F.filter(levels, lambda e: e["price"] == best)
    total = F.aggregate(at_best, F.lit(0.0), lambda acc, e: acc + e["price"] * e["size"])
    return F.when(best.isNotNull(), total)


def quote_etl(raw: DataFrame, levels: int | None = None) -> DataFrame:
    """(venue, condition_id, ts_s, payload) to quote rows, both book shapes.

    Depth is price times size at the best price, unknown rather than zero when
    it was not quoted. In the two-bid shape a NO bid at q is a YES offer at
    1 - q, and the last trade stands in when there is no two-sided quote. The
    whole ladder is kept unless `levels` bounds it.
    """
    two_bid = F.col("venue") == TWO_BID_VENUE
    df = (raw.withColumn("a", F.when(~two_bid, F.from_json("payload", BOOK)))
          .withColumn("b", F.when(two_bid, F.from_json("payload", TWO_BID))))
    a_bids = _levels(F.col("a.bids"), lambda e: e["price"], lambda e: e["size"])
    a_asks = _levels(F.col("a.asks"), lambda e: e["price"], lambda e: e["size"])
    book = F.coalesce("b.orderbook_fp", "b.orderbook")
    df = df.withColumn("book", book)

    def side(fp: str, plain: str) -> Column:
        return F.filter(_levels(F.coalesce(f"book.{fp}", f"book.{plain}"), lambda e: F.get(e, F.lit(0)), lambda e: F.get(e, F.lit(1))),
                        lambda e: (e["size"] > 0) & e["price"].between(0, 1))
    b_asks = F.transform(side("no_dollars", "no"), lambda e: F.struct((1 - e["price"]).alias("price"), e["size"].alias("size")))
    df = (df.withColumn("bid_levels", F.when(two_bid, side("yes_dollars", "yes")).otherwise(a_bids))
          .withColumn("ask_levels", F.when(two_bid, b_asks).otherwise(a_asks)))

    m = {c: number(F.col(f"b.market.{c}")) for c in
         ("yes_bid_dollars", "yes_ask_dollars", "last_price_dollars", "yes_bid_size_fp", "yes_ask_size_fp", "open_interest_fp")}
    bid = F.when(two_bid, m["yes_bid_dollars"]).otherwise(F.array_max(F.transform("bid_levels", lambda e: e["price"])))
    ask = F.when(two_bid, m["yes_ask_dollars"]).otherwise(F.array_min(F.transform("ask_levels", lambda e: e["price"])))
    df = df.withColumn("best_bid", bid).withColumn("best_ask", ask)
    last = m["last_price_dollars"]
    middle = (F.col("best_bid") + F.col("best_ask")) / 2
    quoted = (F.col("best_bid") > 0) & (F.col("best_bid") <= 1) & (F.col("best_ask") > 0) & (F.col("best_ask") <= 1)
    mid = F.when(~two_bid, middle).when(quoted, middle).when((last > 0) & (last < 1), last)

    def notional(price: Column, size: Column) -> Column:
        return F.when((price > 0) & (size > 0), price * size)
    readable = F.when(two_bid, F.col("b.market").isNotNull()).otherwise(F.col("a").isNotNull() & (F.col("a.bids").isNotNull() | F.col("a.asks").isNotNull()))
    return df.select(
        "condition_id", "ts_s", "venue", "best_bid", "best_ask", mid.alias("mid"),
        (F.col("best_ask") - F.col("best_bid")).alias("spread"),
        F.when(two_bid, notional(F.col("best_bid"), m["yes_bid_size_fp"])).otherwise(_depth(F.col("bid_levels"), F.col("best_bid"))).alias("bid_depth_usd"),
        F.when(two_bid, notional(F.col("best_ask"), m["yes_ask_size_fp"])).otherwise(_depth(F.col("ask_levels"), F.col("best_ask"))).alias("ask_depth_usd"),
        last.alias("last_trade_price"), m["open_interest_fp"].alias("open_interest"),
        _ladder(F.col("bid_levels"), True, levels).alias("bids"), _ladder(F.col("ask_levels"), False, levels).alias("asks"),
        F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(mid.isNull(), "no_price").alias("reject_reason"))


def _text(path: str) -> Column:
    return F.get_json_object("payload", path)


def _list(path: str) -> Column:
    """A JSON list, whether landed as a list or as a text holding one."""
    return F.from_json(_text(path), "array<string>")


def _flag(path: str) -> Column:
    return (F.coalesce(_text(path), F.lit("false")) == "true").cast("int")


# Venue status words.
OPEN_WORDS, CLOSED_WORDS = ("active", "initialized"), ("finalized", "closed")


def market_etl(raw: DataFrame) -> DataFrame:
    """(venue, payload) venue objects to one market row each.

    Binary means outcomes exactly yes and no with two tokens on the default
    venue; the others list binary markets only. Keys of other venues carry the
    venue as prefix.
    """
    v = F.col("venue")
    poly, kal, man = v == "polymarket", v == "kalshi", v == "manifold"
    native = F.when(poly, _text("$.conditionId")).when(kal, _text("$.ticker")).when(man, _text("$.id"))
    outcomes = F.transform(_list("$.outcomes"), F.lower)
    tokens = _list("$.clobTokenIds")
    binary = F.when(poly, F.coalesce((F.array_join(outcomes, "|") == "yes|no") & (F.size(outcomes) == 2) & (F.size(tokens) == 2), F.lit(False))).otherwise(True)
    status = _text("$.status")
    closing = _text("$.closeTime").try_cast("double")
    end = (F.when(poly, F.coalesce(X.venue_ts(_text("$.endDate")), X.venue_ts(F.concat(_text("$.endDate"), F.lit("T00:00:00Z")))))
           .when(kal, X.venue_ts(F.coalesce(_text("$.close_time"), _text("$.expiration_time"))))
           .when(man, F.floor(closing / 1000).cast("long")))
    resolved = _flag("$.isResolved")
    category = F.coalesce(F.nullif(F.lower(F.trim(_text("$.category"))), F.lit("")), F.lit("unknown"))
    return raw.select(
        "venue", native.alias("venue_native_id"),
        F.when(poly, native).otherwise(F.concat_ws(":", v, native)).alias("condition_id"),
        F.when(kal, F.lit(None).cast("string")).otherwise(_text("$.slug")).alias("slug"),
        F.when(kal, _text("$.title")).otherwise(_text("$.question")).alias("question"),
        F.when(kal, _text("$.rules_primary")).when(poly, _text("$.description")).alias("description"),
        F.when(man, "unknown").otherwise(category).alias("category"), end.alias("end_s"),
        F.when(poly & binary, F.get(tokens, F.lit(0))).alias("token_id_yes"), F.when(poly & binary, F.get(tokens, F.lit(1))).alias("token_id_no"),
        F.when(poly, _flag("$.negRisk")).otherwise(0).alias("neg_risk"),
        F.when(poly, _flag("$.active")).when(kal, F.coalesce(status.isin(*OPEN_WORDS), F.lit(False)).cast("int")).otherwise(1 - resolved).alias("active"),
        F.when(poly, _flag("$.closed")).when(kal, F.coalesce(status.isin(*CLOSED_WORDS), F.lit(False)).cast("int")).otherwise(resolved).alias("closed"),
        F.when(poly, number(_text("$.liquidityNum"))).when(kal, number(_text("$.liquidity_dollars"))).alias("liquidity_num"),
        F.when(poly, number(_text("$.volumeNum"))).when(kal, number(_text("$.volume_fp"))).otherwise(number(_text("$.volume"))).alias("volume_num"),
        F.when(poly, number(_text("$.volume24hr"))).when(kal, number(_text("$.volume_24h_fp"))).alias("volume_24h_num"),
        binary.cast("int").alias("is_binary"),
        F.when(native.isNull(), "no_key").when(~binary, "non_binary").alias("reject_reason"))


def payout_etl(raw: DataFrame) -> DataFrame:
    """(venue, payload) to final payouts; anything not a clean binary outcome gets a reason."""
    v = F.col("venue")
    poly, kal, meta, man = v == "polymarket", v == "kalshi", v == "metaculus", v == "manifold"
    native = F.when(poly, _text("$.conditionId")).when(kal, _text("$.ticker")).otherwise(_text("$.id"))
    prices = _list("$.outcomePrices")
    first = number(F.get(prices, F.lit(0)))
    words = F.lower(F.array_join(_list("$.umaResolutionStatuses"), " "))
    contested = F.coalesce(words.contains("disputed"), F.lit(False))
    pending = contested & ~words.contains("resolved")
    result = F.lower(F.trim(_text("$.question.resolution")))
    payout = (
        F.when(poly & (_flag("$.closed") == 1) & (F.size(prices) >= 2) & first.isin(0.0, 1.0) & ~pending, first)
        .when(kal & (_text("$.status") == "finalized"), F.when(_text("$.result") == "yes", 1.0).when(_text("$.result") == "no", 0.0))
        .when(meta, F.when(result == "yes", 1.0).when(result == "no", 0.0).when(number(result).isin(0.0, 1.0), number(result)))
        .when(man & (_flag("$.isResolved") == 1), F.when(_text("$.resolution") == "YES", 1.0).when(_text("$.resolution") == "NO", 0.0)))
    moment = (F.when(poly, X.venue_ts(_text("$.closedTime"))).when(kal, X.venue_ts(_text("$.settlement_ts")))
              .when(man, F.floor(number(_text("$.resolutionTime")) / 1000).cast("long")))
    is_open = ((poly & (_flag("$.closed") == 0)) | (kal & (F.coalesce(_text("$.status"), F.lit("")) != "finalized"))
               | (meta & result.isNull()) | (man & (_flag("$.isResolved") == 0)))
    return raw.select(
        "venue", F.when(poly, native).otherwise(F.concat_ws(":", v, native)).alias("condition_id"),
        payout.alias("payout_yes"), (poly & contested).cast("int").alias("disputed"), moment.alias("venue_resolved_s"),
        F.when(native.isNull(), "no_key").when(payout.isNotNull(), F.lit(None).cast("string")).when(is_open, "open")
        .when(poly & pending, "dispute_open").otherwise("not_binary").alias("reject_reason"))


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is not null").groupBy("venue", "reject_reason").agg(F.count(F.lit(1)).alias("n"))
