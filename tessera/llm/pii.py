"""Personal data by bootstrapped contextual extraction.

Seeds are the identifiers of four kinds that regular expressions prove (email,
ip, card with Luhn check, phone). Every seed is an occurrence with lexical
patterns: the two words before it, and the word before with the word after,
brackets trimmed. So are the candidates that touch no seed: tokens with a digit or
an @ in them, and numbers written in several groups (``JOINED_PATTERN``) of
``JOINED_DIGITS`` digits together. A token without a digit can only become an email, a
number in groups only a card or a phone. Patterns and values form a graph; its scores
are computed iteratively by aggregations over the distinct (pattern, value)
edges:

* a value proved by a seed counts 1 for its kind and nothing for the others;
* a pattern's confidence for a kind is the mean of its values' scores;
* an unproved value's score is the mean confidence of its patterns.

After ``ROUNDS`` rounds a pattern is trusted for a kind with ``MIN_SUPPORT``
distinct seed values or more and a confidence of ``MIN_CONFIDENCE`` or more; an
unproved token that stands in a trusted pattern and itself scores that high is
reported as that kind, but not inside a longer one of its kind. Seeds always stay.

Everything is DataFrame functions. Positions come without any marker in the
text: ``split`` gives the stretches between the matches that
``regexp_extract_all`` gives, and running sums of their lengths are the code
point positions (in blocks, so thousands of matches in a text do not make it
quadratic). The expressions never start inside a run that a start before it has
refused, so long runs are read once.

Defined cases: null text counts as empty; rows that repeat an id are answered
one by one (rows carry a number given as data); a null ``doc_id`` comes back as
null; an empty table gives an empty result; other columns are ignored unless
carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, merged, pick, written

KINDS = ["email", "ip", "card", "phone"]  # fixed order

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
WORTH = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]*[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

_TOKEN = "[A-Za-z0-9._%+@-]"
_JUNK = "._%+@-"
TOKEN_PATTERN = rf"(?<!{_TOKEN})[A-Za-z._%+-]*+[0-9@]{_TOKEN}*+"
# Groups of digits with blanks, dots, hyphens or brackets between them.
JOINED_PATTERN = rf"(?<!{_TOKEN})[+(]{{0,2}}+[0-9]++(?:[\x20().-]{{1,3}}+[0-9]++)++"
JOINED_DIGITS = (7, 38)  # a local phone number; two cards in a row

ROUNDS = 3
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
BLOCK = 256
CONTEXT_CHARS = 96  # context words longer than this are cut to their nearer end

_SPAN = "array<struct<start:bigint,rank:int,stop:bigint>>"


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _with_starts(df: DataFrame, m: str, p: str, s: str) -> DataFrame:
    """Add ``s``: the start of each match. Sums run within blocks of ``BLOCK``
    matches; the blocks' bases are a column of their own, since what a lambda
    holds is computed for every element."""
    both, base = f"{s}_both", f"{s}_base"
    some = F.size(m) > 0
    df = df.withColumn(both, F.when(some, F.zip_with(F.slice(p, 1, F.size(m)), m, lambda g, x: (
        F.length(g) + F.length(x)).cast("long"))))
    df = df.withColumn(base, F.when(F.size(both) > 0, F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.size(both) / BLOCK).cast("int") - 1), F.array(F.lit(0).cast("long")),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + _total(F.slice(both, k * BLOCK + 1, BLOCK)))))))

    def start(value, i):
        k = F.floor(i / BLOCK).cast("int")
        return F.get(base, k) + _total(F.slice(both, k * BLOCK + 1, i - k * BLOCK)) + F.length(F.get(p, i))

    return df.withColumn(s, F.when((F.size(both) > 0) & (F.size(base) > 0), F.transform(m, start))).drop(both, base)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        n = F.length(digits)
        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(
            (n - i) % 2 == 1, F.substr(F.lit("0246813579"), F.substr(digits, i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
        return n.between(12, 19) & F.when(n.between(12, 19), luhn % 10 == 0).otherwise(False)
    return F.lit(True)


def _checked(kind: str):
    return lambda o: _valid(kind, o["value"])


def _near_words(stretch: Column, before: Column, last: bool) -> Column:
    """Words of the stretch next to a match, the nearest first, ended by a mark
    for the text's edge or for another match."""
    cut = F.substring(stretch, -CONTEXT_CHARS, CONTEXT_CHARS) if last else F.substring(stretch, 1, CONTEXT_CHARS)
    words = F.transform(F.split(F.lower(cut), f"[{SPACE}]+"), lambda w: F.trim(w, F.lit("()[]{}")))
    words = F.filter(words, lambda w: w != "")
    return F.concat(F.reverse(words) if last else words, F.array(before))


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of an occurrence."""
    two = F.concat_ws(" ", F.coalesce(F.get(left, F.lit(1)), F.lit("")), F.get(left, F.lit(0)), F.lit("_"))
    one = F.concat_ws(" ", F.get(left, F.lit(0)), F.lit("_"), F.get(right, F.lit(0)))
    return F.array(two, one)


def _found(df: DataFrame, name: str, pattern: str, worth: Column) -> DataFrame:
    """Columns ``<name>_m`` (matches), ``<name>_p`` (stretches), ``<name>_s`` (starts)."""
    m, p, s = f"{name}_m", f"{name}_p", f"{name}_s"
    df = df.withColumn(m, F.when(worth, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split("text", pattern, -1)))
    return _with_starts(df, m, p, s)


def _occurrences(name: str, rank: Column) -> Column:
    """The matches of ``_found`` as structs with their contexts."""
    m, p, s = F.col(f"{name}_m"), F.col(f"{name}_p"), F.col(f"{name}_s")

    def one(value, i):
        left = _near_words(F.get(p, i), F.when(i == 0, F.lit("<s>")).otherwise(F.lit("<id>")), True)
        right = _near_words(F.get(p, i + 1), F.when(i == F.size(m) - 1, F.lit("</s>")).otherwise(F.lit("<id>")), False)
        return F.struct(F.get(s, i).alias("start"), rank.alias("rank"), (F.get(s, i) + F.length(value)).alias("stop"),
                        value.alias("value"), _patterns(left, right).alias("patterns"))

    return F.transform(m, one)


_OCCURRENCE = "array<struct<start:bigint,rank:int,stop:bigint,value:string,patterns:array<string>>>"


def base_occurrences(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, base, others`` and the ``carry`` columns: the seeds, and the
    candidates that touch no seed."""
    extra = [c for c in dict.fromkeys(carry) if c not in ("doc_id", "text")]
    df = pick(docs, "doc_id", "text", *extra)
    df = df.select("doc_id", *[F.col(c).alias(f"v_{c}") for c in extra], F.col("text").isNull().alias("no_text"),
                   F.coalesce("text", F.lit("")).alias("text"))
    parts = []
    for rank, kind in enumerate(KINDS):
        df = _found(df, kind, PATTERNS[kind], F.col("text").rlike(WORTH[kind]))
        parts.append(F.coalesce(F.filter(_occurrences(kind, F.lit(rank)), _checked(kind)), F.array().cast(_OCCURRENCE)))
    df = df.withColumn("base", F.array_sort(F.concat(*parts)))
    df = _found(df, "token", TOKEN_PATTERN, F.col("text").rlike("[0-9@]"))
    df = _found(df, "joined", JOINED_PATTERN, F.col("text").rlike(r"[0-9][\x20().-]{1,3}[0-9]"))

    def trimmed(o):
        lead = F.length(o["value"]) - F.length(F.ltrim(o["value"], F.lit(_JUNK)))
        value = F.trim(o["value"], F.lit(_JUNK))
        return F.struct((o["start"] + lead).alias("start"), o["rank"].alias("rank"),
                        (o["start"] + lead + F.length(value)).alias("stop"), value.alias("value"),
                        o["patterns"].alias("patterns"))

    def unbracketed(o):
        alone = (F.substring(o["value"], 1, 1) == "(") & ~F.contains(o["value"], F.lit(")"))
        return F.struct(F.when(alone, o["start"] + 1).otherwise(o["start"]).alias("start"), o["rank"].alias("rank"),
                        o["stop"].alias("stop"), F.when(alone, F.ltrim(o["value"], F.lit("("))).otherwise(o["value"]).alias("value"),
                        o["patterns"].alias("patterns"))

    def in_groups(o, i):
        digits = F.length(F.regexp_replace(o["value"], "[^0-9]", ""))
        ended = ~F.get("joined_p", i + 1).rlike("^[A-Za-z_%@]")  # the last group is a whole token
        return o["value"].rlike(r"[\x20()]") & digits.between(*JOINED_DIGITS) & ended

    tokens = F.transform(_occurrences("token", F.lit(None).cast("int")), trimmed)
    tokens = F.coalesce(F.filter(tokens, lambda o: o["value"].rlike("[0-9@]")), F.array().cast(_OCCURRENCE))
    joined = F.transform(F.filter(_occurrences("joined", F.lit(None).cast("int")), in_groups), unbracketed)
    joined = F.filter(joined, lambda o: o["value"].rlike(r"[\x20()]"))
    df = df.withColumn("candidates", F.concat(tokens, F.coalesce(joined, F.array().cast(_OCCURRENCE))))
    free = F.filter("candidates", lambda o: ~F.exists("base", lambda b: (b["start"] < o["stop"]) & (o["start"] < b["stop"])))
    return df.select("doc_id", *[f"v_{c}" for c in extra], *(["no_text", "text"] if "text" in carry else []), "base",
                     F.coalesce(free, F.array().cast(_OCCURRENCE)).alias("others"))


def pattern_scores(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Iterate over distinct edges ``(pattern, value, seed)`` (seed: the kind's
    rank or null) and return (patterns with ``support_k`` and ``conf_k``, values
    with ``score_k``) for the kinds k."""
    kinds = range(len(KINDS))
    state = edges.select("pattern", "value", "seed", *[
        F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(f"score_{k}") for k in kinds])
    for r in range(ROUNDS):
        pats = state.groupBy("pattern").agg(
            *[F.sum(F.when(F.col("seed") == k, 1).otherwise(0)).alias(f"support_{k}") for k in kinds],
            *[F.avg(f"score_{k}").alias(f"conf_{k}") for k in kinds])
        values = state.filter("seed is null").select("pattern", "value").join(merged(pats), "pattern").groupBy("value").agg(
            *[F.avg(f"conf_{k}").alias(f"new_{k}") for k in kinds])
        if r + 1 == ROUNDS:
            break
        state = written(state.join(merged(values), "value", "left").select("pattern", "value", "seed", *[
            F.when(F.col("seed").isNotNull(), F.col(f"score_{k}")).otherwise(F.coalesce(f"new_{k}", F.lit(0.0)))
            .alias(f"score_{k}") for k in kinds]), f"pii-round-{r}")
    return pats, values.select("value", *[F.col(f"new_{k}").alias(f"score_{k}") for k in kinds])


def find_pii(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``found`` (arrays of
    ``start, rank, stop``; rank indexes ``KINDS``, stop is exclusive, positions
    are code points) and the ``carry`` columns."""
    table = written(base_occurrences(docs, carry).withColumn("uid", F.monotonically_increasing_id()), "pii-occurrences")
    seen = table.select("uid", F.explode(F.concat("base", "others")).alias("o")).select(
        "uid", "o.start", "o.stop", F.col("o.rank").alias("seed"), "o.value", F.explode("o.patterns").alias("pattern"))
    edges = written(seen.select("pattern", "value", "seed").distinct(), "pii-edges")
    pats, values = pattern_scores(edges)
    kinds = range(len(KINDS))
    trusted = pats.select("pattern", F.explode(F.array(*[F.struct(
        F.lit(k).alias("rank"), F.col(f"conf_{k}").alias("conf"), F.col(f"support_{k}").alias("support"))
        for k in kinds])).alias("t")).select("pattern", "t.*").filter(
            (F.col("support") >= MIN_SUPPORT) & (F.col("conf") >= MIN_CONFIDENCE))
    good = values.select("value", F.explode(F.array(*[F.struct(
        F.lit(k).alias("rank"), F.col(f"score_{k}").alias("score")) for k in kinds])).alias("t")).select(
            "value", "t.*").filter(F.col("score") >= MIN_CONFIDENCE)
    new = seen.filter("seed is null").join(merged(trusted), "pattern").join(merged(good), ["value", "rank"])
    in_groups, digit = F.col("value").rlike(r"[\x20()]"), F.col("value").rlike("[0-9]")
    new = new.filter(F.when(in_groups, F.col("rank").isin(KINDS.index("card"), KINDS.index("phone")))
                     .otherwise(digit | (F.col("rank") == KINDS.index("email"))))
    found = new.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct(
        F.col("start"), F.col("rank").cast("int").alias("rank"), F.col("stop")))).alias("found"))
    found = found.withColumn("found", F.filter("found", lambda o: ~F.exists("found", lambda w: (
        w["rank"] == o["rank"]) & (w["start"] <= o["start"]) & (o["stop"] <= w["stop"])
        & (w["stop"] - w["start"] > o["stop"] - o["start"]))))
    base = F.transform("base", lambda o: F.struct(o["start"].alias("start"), o["rank"].alias("rank"), o["stop"].alias("stop")))
    held = [c for c in table.columns if c.startswith("v_")] + (["no_text", "text"] if "text" in carry else [])
    return table.join(merged(found), "uid", "left").select(
        "doc_id", base.alias("base"), F.coalesce("found", F.array().cast(_SPAN)).alias("found"),
        *[F.col(c).alias(c.removeprefix("v_")) for c in held])


def span_text(spans: Column) -> Column:
    """``kind:start:stop`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda o: F.concat_ws(
        ":", F.get(names, o["rank"]), o["start"].cast("string"), o["stop"].cast("string"))), ",")


def masked(df: DataFrame, spans: Column, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``<KIND>``; of overlapping
    spans the first one names the whole stretch they cover."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def join(acc, s):
        last = F.get(acc["open"], F.lit(0))
        longer = F.struct(last["start"].alias("start"), last["rank"].alias("rank"),
                          F.greatest(last["stop"], s["stop"]).alias("stop"))
        meets = (F.size(acc["open"]) > 0) & (s["start"] < last["stop"])
        return F.struct(
            F.when(meets, acc["done"]).otherwise(F.concat(acc["done"], acc["open"])).alias("done"),
            F.when(meets, F.array(longer)).otherwise(F.array(s)).alias("open"))

    none = F.array().cast(_SPAN)
    df = df.withColumn("_merged", F.when(F.size(spans) > 0, F.aggregate(
        F.array_sort(spans), F.struct(none.alias("done"), none.alias("open")), join,
        lambda acc: F.concat(acc["done"], acc["open"]))))

    def piece(s, i):
        at = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("_merged", i - 1)["stop"]).cast("int")
        return F.concat(F.substr(text, at + 1, s["start"].cast("int") - at), F.get(names, s["rank"]))

    tail = F.substr(text, F.element_at("_merged", -1)["stop"].cast("int") + 1, F.length(text))
    return df.withColumn(text, F.when(F.size("_merged") > 0, F.concat(
        F.array_join(F.transform("_merged", piece), ""), tail)).otherwise(F.col(text))).drop("_merged")
