"""Sequential packing as array folds evaluated inside the JVM, one array at a time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellum.functions import text as T, vocab


def pack_units(units: Column, budget: int) -> Column:
    """Greedy packing of ``array<struct<text, size, scope, solid, sep>>`` into strings.

    A unit joins the open piece unless that overflows ``budget``, changes the scope,
    or either side is solid; an oversized unit still gets a piece of its own.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"),
                     F.lit(0).alias("size"), F.lit(0).alias("scope"), F.lit(False).alias("solid"))

    def step(a: Column, u: Column) -> Column:
        close = (a["scope"] != u["scope"]) | a["solid"] | u["solid"] | (a["size"] + u["size"] > budget)
        opened = F.struct(a["done"].alias("done"), u["text"].alias("cur"), u["size"].alias("size"),
                          u["scope"].alias("scope"), u["solid"].alias("solid"))
        shut = F.struct(F.concat(a["done"], F.array(a["cur"])).alias("done"), u["text"].alias("cur"),
                        u["size"].alias("size"), u["scope"].alias("scope"), u["solid"].alias("solid"))
        grown = F.struct(a["done"].alias("done"), F.concat(a["cur"], u["sep"], u["text"]).alias("cur"),
                         (a["size"] + u["size"]).alias("size"), u["scope"].alias("scope"), F.lit(False).alias("solid"))
        return F.when(a["cur"].isNull(), opened).when(close, shut).otherwise(grown)

    return F.aggregate(units, start, step, lambda a: F.when(
        a["cur"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def batch_numbers(costs: Column, budget: int) -> Column:
    """1-based batch of every cost: a new batch opens when a non-empty one would overflow."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).cast("bigint").alias("used"), F.lit(1).alias("batch"))

    def step(a: Column, c: Column) -> Column:
        spill = (F.size(a["out"]) > 0) & (a["used"] + c > budget)
        batch = a["batch"] + F.when(spill, 1).otherwise(0)
        return F.struct(F.concat(a["out"], F.array(batch)).alias("out"),
                        F.when(spill, c).otherwise(a["used"] + c).alias("used"), batch.alias("batch"))

    return F.aggregate(costs, start, step, lambda a: a["out"])


def char_windows(text: Column, width: int, overlap: int = 0) -> Column:
    """Fixed-stride windows; the last one reaches the end of the text."""
    step = width - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    many = T.let(text, lambda t: F.transform(F.sequence(F.lit(0), n - 1),
                                             lambda i: F.substring(t, i * step + 1, F.lit(width))))
    return F.when(F.length(text) <= width, F.array(text)).otherwise(many)


def word_windows(text: Column, most: int) -> Column:
    long, over = vocab.CHUNKING["max_chars"], vocab.CHUNKING["overlap_chars"]

    def windows(words: Column) -> Column:
        last = F.greatest(F.lit(1), F.ceil(F.size(words) / most)).cast("int") - 1
        joined = F.transform(F.sequence(F.lit(0), last),
                             lambda i: F.array_join(F.slice(words, i * most + 1, most), " "))
        return F.flatten(F.transform(joined, lambda s: char_windows(s, long, over)))

    return T.let(T.space_tokens(text), windows)


def simulated_pages(text: Column) -> Column:
    """Equal slices of about one page each for text longer than one and a half pages."""
    per = vocab.CHUNKING["chars_per_page"]
    size = F.greatest(F.lit(vocab.CHUNKING["min_page_chars"]),
                      F.floor(F.length(text) / F.greatest(F.lit(1), F.floor(F.length(text) / per)))).cast("int")
    n = F.ceil(F.length(text) / size).cast("int")
    many = T.let(text, lambda t: F.transform(F.sequence(F.lit(0), n - 1),
                                             lambda i: F.substring(t, i * size + 1, size)))
    return F.when(F.length(text) <= per * 1.5, F.array(text)).otherwise(many)


def segment_numbers(lengths: Column, segments: Column) -> Column:
    """Split consecutive items into about ``segments`` groups of equal total length.

    A group closes once it reaches the target while fewer than ``segments - 1``
    groups are closed.
    """
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + x)
    target = total / F.greatest(segments, F.lit(1))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).cast("bigint").alias("used"), F.lit(1).alias("seg"))

    def step(a: Column, x: Column) -> Column:
        used = a["used"] + x
        close = (used >= target) & (a["seg"] - 1 < segments - 1)
        return F.struct(F.concat(a["out"], F.array(a["seg"])).alias("out"),
                        F.when(close, F.lit(0).cast("bigint")).otherwise(used).alias("used"),
                        F.when(close, a["seg"] + 1).otherwise(a["seg"]).alias("seg"))

    return F.aggregate(lengths, start, step, lambda a: a["out"])


def even_sample(items: Column, want: Column) -> Column:
    """``want`` evenly spaced elements (index floor(i * n / want)); everything when it fits."""
    stride = F.size(items) / want
    picks = F.transform(F.sequence(F.lit(0), F.greatest(want, F.lit(1)) - 1),
                        lambda i: F.element_at(items, (F.floor(i * stride) + 1).cast("int")))
    return F.when(F.size(items) <= want, items).otherwise(picks)
