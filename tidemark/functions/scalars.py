"""Scalar expressions: ids, hashes, times, number formats, parameter ranges, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"
DAY_MS = 86_400_000
YEAR_MS = 365.25 * DAY_MS
# Milliseconds of each timeframe.
TIMEFRAME_MS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "1d": DAY_MS}


def slugify(name: Column) -> Column:
    """Lower case, other characters as one hyphen, no hyphen at either end, at most 50 characters."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 50)


def spec_id(name: Column, raw_hash: Column) -> Column:
    return F.concat_ws("-", slugify(name), F.substring(raw_hash, 1, 6))


def raw_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text as it came."""
    return F.substring(F.sha2(text, 256), 1, 16)


def normalise_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def day(ms: Column) -> Column:
    """Epoch milliseconds as a UTC date, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int")), "yyyy-MM-dd")


def timeframe_ms(timeframe: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TIMEFRAME_MS.items() for x in pair])
    return F.try_element_at(table, timeframe)


def _signed(x: Column, digits: int) -> Column:
    number = F.format_string(f"%.{digits}f%%", F.abs(x))
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit(MINUS)), number)


def pct(x: Column) -> Column:
    """Signed, one decimal, with a typographic minus."""
    return _signed(x.cast("double"), 1)


def ipct(x: Column) -> Column:
    return _signed(x.cast("double"), 0)


def js_round(x: Column) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(x + 0.5)


def clean_link(url: Column) -> Column:
    """A script link without query, fragment and trailing slash; NULL for other links."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/$", "")
    return F.when(url.rlike(r"/script/[A-Za-z0-9]+") & ~url.contains("/scripts/"), bare)


def param_range(name: Column, value: Column) -> Column:
    """struct(lo, hi, int) to search around a default, by the parameter's name; NULL where it is not swept."""
    n, v = F.lower(name), value.cast("double")
    shape = lambda lo, hi, whole: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), whole.alias("int"))
    length = shape(F.greatest(F.lit(2.0), js_round(v * 0.4)), F.greatest(F.lit(6.0), js_round(v * 2.5)), F.lit(True))
    level = shape(v * 0.5, F.when(v == 0, F.lit(1.0)).otherwise(v * 1.5), F.lit(False))
    mult = shape(F.greatest(F.lit(0.1), v * 0.3), F.when(v == 0, F.lit(3.0)).otherwise(v * 3), F.lit(False))
    other = shape(v * 0.5, v * 1.5, v == F.floor(v))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return (
        F.when(~finite, None)
        .when(n.rlike("len|length|period|lookback|bars$"), length)
        .when(n.rlike("level|thresh|band"), level)
        .when(n.rlike("mult|factor|ratio|pct|percent|dev"), mult)
        .when(v != 0, other)
    )


def sample_param(rng: Column, seed: int, *ids: Column) -> Column:
    """A draw from a `param_range`, the same for the same seed and ids: whole numbers, or four decimals. The first 52 bits of an MD5 digest are the random number."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *[i.cast("string") for i in ids]))
    unit = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    x = rng["lo"] + unit * (rng["hi"] - rng["lo"])
    return F.when(rng["int"], js_round(x).cast("double")).otherwise(js_round(x * 10_000) / 10_000)


def verdict(best: Column, min_trades: int = 5) -> Column:
    """What a sweep's best configuration says; best: struct(train_sharpe, test_sharpe, test_return, test_trades)."""
    sharpe = F.coalesce(best["test_sharpe"], F.lit(float("-inf")))
    gain = F.coalesce(best["test_return"], F.lit(float("-inf")))
    enough = F.coalesce(best["test_trades"], F.lit(0)) >= max(3, -(-min_trades // 2))
    return (
        F.when(best.isNull() | best["train_sharpe"].isNull(), "no-signal")
        .when(best["train_sharpe"] < 1, "weak")
        .when((sharpe >= 1) & (gain > 0), F.when(enough, "holds").otherwise("thin"))
        .when(sharpe >= 0.5, "marginal")
        .otherwise("overfit")
    )


def confidence(strategy_type: Column, n_indicators: Column, direction: Column, evaluable: Column, n_parameters: Column, has_exit: Column, complexity: Column) -> Column:
    """How much of a script was understood, 0 to 1, two decimals."""
    points = lambda test, p: F.when(F.coalesce(test, F.lit(False)), F.lit(p)).otherwise(F.lit(0.0))
    score = points(strategy_type.isNotNull(), 0.2) + points(n_indicators > 0, 0.2) + points(direction.isNotNull(), 0.2)
    score = score + points(evaluable, 0.2) + points(n_parameters > 0, 0.1) + points(has_exit, 0.1)
    weight = F.when(complexity == "complex", 0.6).when(complexity == "medium", 0.85).otherwise(1.0)
    return js_round(score * weight * 100) / 100


def typical_prices(o: str = "open", h: str = "high", l: str = "low", c: str = "close") -> dict[str, Column]:  # noqa: E741
    """hl2, hlc3 and ohlc4."""
    return {"hl2": (F.col(h) + F.col(l)) / 2, "hlc3": (F.col(h) + F.col(l) + F.col(c)) / 3, "ohlc4": (F.col(o) + F.col(h) + F.col(l) + F.col(c)) / 4}
