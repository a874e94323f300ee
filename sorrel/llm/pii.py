"""Personal data by rules and by bootstrapped contexts, with DataFrame functions only.

Rules find e-mail and IP addresses, card numbers (Luhn) and phone numbers, leftmost and
without overlaps within a kind. Spans come from what a pattern cuts out and what it leaves:
running lengths of both are the places, in code points.

Contexts of labels: a candidate is any token behind a label, such as `token = "..."`: the
label, its sign (`=` or `:`) and an opening quote are the lexical pattern, the token the
instance. Contexts of words: the two words before and the two after, in the same line, are
patterns of every token with a digit (4 characters or more) and of every rule's span.

Instances where a rule's span of any of the four kinds begins, or, behind a label, that are
long hexadecimal strings, are seeds. Patterns and instances form a graph, scored in rounds: a
pattern by the mean score of its distinct instances (one instance that is nothing is always
added, so that few prove little), an instance by the chance that not all of its patterns are
wrong. A pattern is accepted with a high score and enough distinct instances that are seeds or
that patterns accepted in the round before have; so each round can accept patterns that no
seed supports. Tokens of accepted patterns are added as `identifier`, unless they touch a span
that a rule has found; those stay, and so does the longer of two that touch each other.

Counts in the graph are of distinct instances over all documents, pre-aggregated before
they are dealt out.

Cases: a null or empty text has no spans; rows that repeat an id are separate rows; texts
may be of any length and hold any number of spans (arrays are gathered in blocks, and sorted
once where spans meet tokens); columns of any name but those of the result pass through; with
no seeds nothing is added; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused

KINDS = ("email", "ip", "card", "phone")
ADDED = "identifier"
#: The rules' patterns, written so that no attempt is repeated inside a run of characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
LABELLED = r"""(?<![\p{L}\p{N}_-])([\p{L}_][\p{L}\p{N}_-]*+)\x20?([=:])\x20?(["']?)([^\s"']++)"""
HEX = r"^[0-9a-fA-F]{32,}$"
#: A token of free text: letters, digits and what joins them, with a digit and at least 4 characters; the words before and after it, and the characters that are searched for them.
JOIN = r"_.@()/+:#\-"
TOKEN = rf"(?<![\p{{L}}\p{{N}}_.@/+:#-])(?=[\p{{L}}\p{{N}}{JOIN}&&[^0-9]]*+[0-9])(?=[\p{{L}}\p{{N}}{JOIN}]{{4}})[\p{{L}}\p{{N}}]++(?:[{JOIN}]++[\p{{L}}\p{{N}}]++)*+"
BEFORE = r"([\p{L}]+)[^\p{L}\p{N}\n]{1,3}([\p{L}]+)[^\p{L}\p{N}\n]{1,3}$"
AFTER = r"^[^\p{L}\p{N}\n]{1,3}([\p{L}]+)[^\p{L}\p{N}\n]{1,3}([\p{L}]+)"
NEAR = 64
#: Code points of the pieces in which places of a text are looked up; NEAR at least.
PIECE = 256
#: Rounds of scoring; the score and the number of distinct seeds or accepted instances that a pattern needs.
ROUNDS = 3
ACCEPT = 0.6
SEEDS = 3


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """12 to 19 digits whose checksum holds."""
    digits = F.transform(F.split(F.reverse(_digits(match)), ""), lambda c: c.cast("int"))
    value = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(digits, value), F.lit(0), lambda a, b: a + b)
    return F.char_length(_digits(match)).between(12, 19) & (total % 10 == 0)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(IP_VALID),
    "card": luhn,
    "phone": lambda m: F.char_length(_digits(m)).between(9, 15),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: What a text must hold for a rule to be tried at all.
GATES = {"email": "@", "phone": "+", "ip": ".", "card": None}

SPAN = "array<struct<start: int, kind: int, stop: int, text: string>>"


#: Entries that are appended to one array before it is laid beside the others.
BLOCK = 128


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def gathered(n: Column, kind: str, one: Callable[[Column, Column], tuple[Column, Column]], start: int = 0) -> Column:
    """The arrays (of type kind) that one(at, i) gives for i = 0 .. n - 1, end to end; `at`, an int, is carried from each to the next.

    An array that grows by one entry at a time is copied as often as it has entries; here blocks
    grow, and the blocks are flattened once."""

    def step(acc: Column, i: Column) -> Column:
        at, out = one(acc["at"], i)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], out.cast(kind)).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        places = F.sequence(first, F.least(first + BLOCK, n) - 1)
        own = F.aggregate(places, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return _with(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    empty = F.struct(F.lit(start).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    every = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), empty, block, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, every).otherwise(F.array().cast(kind))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern: start, kind, stop, text."""

    def placed(found: Column) -> Column:
        def of(gaps: Column) -> Column:
            def one(at: Column, i: Column) -> tuple[Column, Column]:
                start = at + F.char_length(F.get(gaps, i))
                stop = start + F.char_length(F.get(found, i))
                return stop, F.array(F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), stop.cast("int").alias("stop"), F.get(found, i).alias("text")))

            return gathered(F.size(found), SPAN, one)

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(_with(F.split(text, pattern, -1), of))

    return _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


#: Candidates; `free`: they touch no span of a rule.
ITEM = "array<struct<start: int, tag: int, stop: int, pattern: string, token: string, free: boolean>>"
FAR = 2**31 - 1


def marked_free(items: Column, base: Column) -> Column:
    """items (start, tag, stop, pattern, token, free) with `free` set by whether they touch none of the spans. One sort, then one pass each way."""

    def item(x: Column, free: Column) -> Column:
        return F.array(F.struct(x["start"].alias("start"), x["tag"].alias("tag"), x["stop"].alias("stop"), x["pattern"].alias("pattern"), x["token"].alias("token"), free.alias("free")))

    def forward(x: Column) -> Column:
        def one(at: Column, i: Column) -> tuple[Column, Column]:
            own = F.get(x, i)
            return F.when(own["tag"] == 0, F.greatest(at, own["stop"])).otherwise(at), item(own, at <= own["start"])

        return gathered(F.size(x), ITEM, one)

    def backward(x: Column) -> Column:
        def one(at: Column, i: Column) -> tuple[Column, Column]:
            own = F.get(x, F.size(x) - 1 - i)
            out = F.when(own["tag"] == 0, F.array().cast(ITEM)).otherwise(item(own, own["free"] & (at >= own["stop"])).cast(ITEM))
            return F.when(own["tag"] == 0, own["start"]).otherwise(at), out

        return gathered(F.size(x), ITEM, one, FAR)

    spans = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("tag"), s["stop"].alias("stop"), F.lit("").alias("pattern"), F.lit("").alias("token"), F.lit(False).alias("free")))
    both = F.array_sort(F.concat(spans.cast(ITEM), items))
    return F.when((F.size(base) == 0) | (F.size(items) == 0), items).otherwise(_with(_with(both, forward), backward))


def rule_spans(text: Column, kind: str) -> Column:
    """The spans of one kind that pass its rule."""
    number = KINDS.index(kind)
    passed = F.filter(matches(text, PATTERNS[kind], number), lambda s: VALID[kind](s["text"]))
    gate = GATES[kind]
    return F.when(text.contains(gate) if gate else text.rlike(CARD), passed).otherwise(F.array().cast(SPAN))


def labelled(text: Column) -> Column:
    """Candidates: tokens behind a label."""
    found = matches(text, LABELLED, len(KINDS))

    def parts(s: Column) -> Column:
        token = F.regexp_extract(s["text"], LABELLED, 4)
        pattern = F.concat(F.lower(F.regexp_extract(s["text"], LABELLED, 1)), F.regexp_extract(s["text"], LABELLED, 2), F.regexp_extract(s["text"], LABELLED, 3))
        return F.struct((s["stop"] - F.char_length(token)).alias("start"), F.lit(1).alias("tag"), s["stop"].alias("stop"), pattern.alias("pattern"), token.alias("token"), F.lit(True).alias("free"))

    return F.when(text.contains("=") | text.contains(":"), F.transform(found, parts).cast(ITEM)).otherwise(F.array().cast(ITEM))


def is_seed(token: Column) -> Column:
    """A token that is a long hexadecimal string, or that a rule accepts whole."""
    whole = lambda p: token.rlike(f"^(?:{p})$")
    hexa = token.rlike(HEX) & token.rlike("[0-9]") & token.rlike("[a-fA-F]")
    rules = whole(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+") | token.rlike(IP_VALID) | (whole(r"[0-9-]{12,}") & luhn(token)) | (whole(PHONE) & VALID["phone"](token))
    return hexa | rules


CONTEXT = "array<struct<start: int, stop: int, pattern: string, token: string, seed: boolean, free: boolean>>"


def contexts(text: Column, base: Column) -> Column:
    """All candidates with their patterns: behind labels, and in free text, where the rules' spans are seeds and each side with two words gives a pattern."""
    words = F.transform(matches(text, TOKEN, len(KINDS)), lambda t: F.struct(t["start"].alias("start"), F.lit(2).alias("tag"), t["stop"].alias("stop"), F.lit("").alias("pattern"), t["text"].alias("token"), F.lit(True).alias("free")))
    words = F.when(text.rlike("[0-9]"), words.cast(ITEM)).otherwise(F.array().cast(ITEM))

    def context(x: Column, pattern: Column, token: Column, seed: Column, free: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), pattern.alias("pattern"), token.alias("token"), seed.alias("seed"), free.alias("free"))

    def sides(pieces: Column, x: Column, token: Column, seed: bool) -> Column:
        # a place far into a long text is found in a piece of it, not from the text's start
        first = F.greatest(F.floor(x["start"] / PIECE) - 1, F.lit(0)).cast("int")
        last = F.floor(x["stop"] / PIECE).cast("int")
        ahead = F.array_join(F.slice(pieces, first + 1, F.lit(2)), "")
        behind = F.array_join(F.slice(pieces, last + 1, F.lit(2)), "")
        low = F.greatest(x["start"] - NEAR, F.lit(0))
        two = lambda part, p: F.when(part.rlike(p), F.concat_ws(" ", F.lower(F.regexp_extract(part, p, 1)), F.lower(F.regexp_extract(part, p, 2))))
        before = F.concat(_with(F.substring(ahead, low - first * PIECE + 1, x["start"] - low), lambda part: two(part, BEFORE)), F.lit(" _"))
        after = F.concat(F.lit("_ "), _with(F.substring(behind, x["stop"] - last * PIECE + 1, F.lit(NEAR)), lambda part: two(part, AFTER)))
        return F.filter(F.array(*[context(x, p, token, F.lit(seed), F.lit(not seed)) for p in (before, after)]), lambda c: c["pattern"].isNotNull())

    def placed(items: Column) -> Column:
        labels = F.filter(items, lambda x: x["tag"] == 1)
        free = F.filter(items, lambda x: (x["tag"] == 2) & x["free"])
        begins = F.transform(base, lambda s: s["start"])
        of_label = F.transform(labels, lambda x: context(x, x["pattern"], x["token"], is_seed(x["token"]) | F.array_contains(begins, x["start"]), x["free"]))
        of_words = lambda pieces: F.concat(F.flatten(F.transform(free, lambda x: sides(pieces, x, x["token"], False))).cast(CONTEXT), F.flatten(F.transform(base, lambda s: sides(pieces, s, s["text"], True))).cast(CONTEXT))
        return F.concat(of_label.cast(CONTEXT), _with(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), of_words))

    found = _with(_with(F.concat(labelled(text), words), lambda items: marked_free(items, base)), placed)
    return F.when(text.rlike("[0-9@=:]"), found).otherwise(F.array().cast(CONTEXT))


def scored_patterns(candidates: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, seeds, support) from rows (pattern, token) and, where a token may be a seed that does not look like one, seed."""
    seed = F.col("seed") | is_seed(F.col("token")) if "seed" in candidates.columns else is_seed(F.col("token"))
    edges = candidates.groupBy("pattern", "token").agg(F.max(seed).alias("seed"))
    edges = scratch.save(edges)
    tokens = edges.groupBy("token").agg(F.max("seed").alias("seed")).select("token", "seed", F.col("seed").cast("double").alias("score"), F.col("seed").alias("sure"))
    patterns = None
    for _ in range(rounds):
        each = edges.select("pattern", "token").join(tokens, "token").groupBy("pattern")
        patterns = scratch.save(each.agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("score"), F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum(F.col("sure").cast("int")).alias("support")))
        wrong = edges.join(patterns.select("pattern", F.col("score").alias("p"), accepted().alias("accepted")), "pattern")
        wrong = wrong.groupBy("token").agg(F.max("seed").alias("seed"), F.max("accepted").alias("accepted"), F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))).alias("wrong"))
        tokens = wrong.select("token", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(1 - F.exp("wrong")).alias("score"), (F.col("seed") | F.col("accepted")).alias("sure"))
    return patterns


def accepted() -> Column:
    return (F.col("score") >= ACCEPT) & (F.col("support") >= SEEDS)


def apart(spans: Column) -> Column:
    """Spans sorted by start; of those that touch each other, the one that starts first, then the longest."""

    def chosen(ordered: Column) -> Column:
        def one(at: Column, i: Column) -> tuple[Column, Column]:
            s = F.get(ordered, i)
            free = at <= s["start"]
            return F.when(free, s["stop"]).otherwise(at), F.when(free, F.array(s)).otherwise(F.array().cast(SPAN))

        return gathered(F.size(ordered), SPAN, one)

    order = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["stop"] - x["stop"])
    return _with(F.array_sort(F.array_distinct(spans), order), chosen)


def find_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with base_spans and added_spans (columns of these names give way): start, kind, stop, text."""
    scratch = Scratch(docs.sparkSession, "pii")
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), "base_spans", "added_spans")]
    row, both, near = (unused(docs, c) for c in ("_row", "_found", "_contexts"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*[rule_spans(text, k) for k in KINDS]))
    found = _with(base, lambda b: F.struct(b.alias("base"), contexts(text, b).alias("contexts")))
    first = docs.select(*rest, F.monotonically_increasing_id().alias(row), found.alias(both))
    first = scratch.save(first.select(*rest, row, F.col(f"{both}.base").alias("base_spans"), F.col(f"{both}.contexts").alias(near)))
    each = first.where(F.size(near) > 0).select(F.col(row).alias("row"), F.explode(near).alias("c")).select("row", "c.*")
    patterns = scored_patterns(each.select("pattern", "token", "seed"), scratch)
    scratch.keep(first, patterns)
    good = patterns.where(accepted()).select("pattern")
    added = each.where("free").join(good, "pattern", "left_semi")
    span = F.struct(F.col("start"), F.lit(len(KINDS)).alias("kind"), F.col("stop"), F.col("token").alias("text"))
    added = added.groupBy(F.col("row").alias(row)).agg(apart(F.collect_list(span).cast(SPAN)).alias("added_spans"))
    return first.join(added, row, "left").select(*rest, "base_spans", F.coalesce("added_spans", F.array().cast(SPAN)).alias("added_spans"))


def written(spans: Column) -> Column:
    """kind:start:stop of all spans, comma-joined, by start, then kind."""
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
