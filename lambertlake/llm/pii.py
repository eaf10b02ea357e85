"""Personal data and secrets found by weak supervision, with DataFrame functions only.

Candidates are what four strict patterns match, whether or not their checks pass, and what
looser patterns match (spelled-out addresses, telephone numbers without a plus, card numbers
with other separators, IPv6, and credentials: runs of letters and digits). Three labelers vote
on each: the regular expression with its check (octets, Luhn, number of digits, variety of
characters; for credentials whether one is assigned), a gazetteer (domain endings, dialling
codes, issuers, reserved networks, forms of keys) and the words around it. Strict matches that
pass their check are taken for true, candidates that fail it for false.
Expectation-maximisation over the counts of vote patterns - at most 5 kinds x 27, so a small
table however large the corpus - finds the truth of the others and how reliable each labeler
is: first over all kinds together, then for each kind, starting from what all kinds taught. The
posteriors train a logistic span classifier over votes and shape, which is then applied as a
column expression. Strict matches that pass their checks always stay; the classifier adds
loose ones that pass theirs, where they overlap no strict one.

Offsets are code points, the end is exclusive. Null and empty texts have no spans. Repeated
rows are treated each on their own; with no candidates at all the classifier adds nothing.
Columns other than the text pass through.

The patterns are written so that a failed attempt isn't tried again from within the same run
of characters (possessive quantifiers, a start at the run's first character or where the last
match ended): they match the same strings in linear time, and have no limit of length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lambertlake.llm import runtime

KINDS = ("email", "ip", "card", "phone", "secret")
#: The classifier's probability from which a loose candidate counts.
THRESHOLD = 0.9
ROUNDS = 60
#: Spans that are looked at together, so that time grows little faster than their number.
BLOCK = 128

_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?[(\[{{] ?at ?[)\]}}] ?[A-Za-z0-9-]++(?: ?(?:[(\[{{] ?dot ?[)\]}}]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+",
}
#: What a text must hold before a pattern is tried at all.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
LOOSE_HINT = {
    "email": r"[(\[{] ?at ?[)\]}]",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]",
    "card": r"[0-9][._/][0-9]{4}[._/]",
    "phone": r"[0-9][ .-][0-9]{4}",
    "secret": r"[A-Za-z0-9_+/-]{12}",
}

# Gazetteers and context words, as patterns.
ENDINGS = "com|org|net|edu|gov|info|biz|io|dev|app|eu|uk|de|fr|es|it|nl|be|ch|at|pl|se|no|dk|fi|pt|ru|cn|jp|in|br|us|ca|au|mx"
DIALLING = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
NEAR = {
    "email": r"mail|contact|kontakt|write|correo|courriel|schreib|reach",
    "ip": r"\bip\b|address|host|server|client|login|from|adresse",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": r"tel|phone|call|mobile|fax|cell|ruf|llam|appel|contact|\bmob",
}
NEAR["secret"] = r"token|secret|passw|passphrase|\bpwd|\bkey\b|api.?key|bearer|credential|\bauth|kennwort|contrase|mot de passe|clave"
#: How a credential is assigned, and forms that keys of known services have.
ASSIGNED = r"(?:[:=]|\bis|\bist|\bes|\best)\s?[\"'`]?$"
KEYS = r"^(?:AKIA|ASIA|ghp_|gho_|sk[-_]|pk_|xox[abp]-|eyJ|AIza|glpat-)"
AGAINST = r"version|\bv\.?$|commit|\bsha|md5|checksum|digest|etag|isbn|issn|order|serial|invoice|ref|page|\bfig|\bid\b|commit|build|bestell|part no"


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once: an expression inside a lambda would be for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column, size: int = BLOCK) -> Column:
    """An array cut into arrays of ``size`` at most; none if it is empty."""
    some = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")))
    return F.coalesce(F.transform(some, lambda b: F.slice(items, b * size + 1, F.lit(size))), F.filter(F.array(items), lambda _: F.lit(False)))


def _before(numbers: Column) -> Column:
    """For each number the sum of those before it: within blocks, then over blocks, so that no long array grows by ones."""

    def sums(block: Column) -> Column:
        add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add)

    def shifted(own: Column) -> Column:
        starts = sums(F.transform(own, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(own, starts, lambda b, start: F.transform(b["out"], lambda x: x + start)))

    return _let(numbers, lambda n: _let(F.transform(_blocks(n), sums), shifted))


def _matches(text: Column, pattern: str) -> Column:
    """All matches: array of (start, stop, value, before, after). Only for texts that have some."""

    def parts(found: Column, gaps: Column) -> Column:
        number = F.size(found)
        ahead = F.zip_with(found, F.slice(gaps, F.lit(1), number), lambda m, g: F.struct(m.alias("value"), F.char_length(g).alias("gap"), F.char_length(m).alias("width"), F.right(g, F.lit(24)).alias("before")))
        return F.zip_with(ahead, F.slice(gaps, F.lit(2), number), lambda p, g: F.struct(p.alias("p"), F.left(g, F.lit(12)).alias("after")))

    def placed(found: Column) -> Column:
        starts = _before(F.transform(found, lambda x: x["p"]["gap"] + x["p"]["width"]))

        def one(x: Column, at: Column) -> Column:
            start = at + x["p"]["gap"]
            return F.struct(start.alias("start"), (start + x["p"]["width"]).alias("stop"), x["p"]["value"].alias("value"), x["p"]["before"].alias("before"), x["after"].alias("after"))

        return F.zip_with(found, starts, one)

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: parts(m, F.split(text, pattern, -1)))
    return _let(found, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(each, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") >= 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{octet}(?:\.{octet}){{3}}$") | value.contains(":")
    if kind == "secret":
        letters = F.size(F.array_distinct(F.split(F.lower(value), "")))
        return (letters >= 8) & (F.length(_digits(value)) >= 3) & ~value.rlike("/[a-z]+/")
    digits = _digits(value)
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    return n.between(10, 15)


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0)


def _votes(kind: str, c: Column, strict: bool) -> list[Column]:
    value = c["value"]
    never = F.lit(False)
    if kind == "email":
        listed = F.lower(value).rlike(rf"[.)\]}}] ?(?:{ENDINGS})$"), F.lower(value).rlike(r"\.(?:png|jpg|gif|js|css|html?)$")
    elif kind == "ip":
        listed = never, value.rlike(r"^(?:0+|127|10|255|22[4-9]|23[0-9])\.|^192\.168\.")
    elif kind == "card":
        listed = value.rlike("^[3-6]"), value.rlike("^[0127-9]")
    elif kind == "secret":
        listed = value.rlike(KEYS), value.rlike("^[A-Za-z]+[-_/]?[0-9]+$|^[0-9]+[-_/]?[A-Za-z]+$")
    else:
        plan = rf"^(?:{DIALLING})" if strict else "^[2-9][0-9]{2}[2-9]"  # of the world, of North America
        listed = _digits(value).rlike(plan), ~_digits(value).rlike(plan)
    around = F.lower(F.concat_ws(" ", c["before"], c["after"]))
    if kind == "secret":
        around = F.lower(c["before"])  # what follows a credential doesn't name it
        shaped = F.when(c["before"].rlike(ASSIGNED), 1).otherwise(0)
    else:
        shaped = F.lit(1 if strict else 0)
    return [
        F.when(_passes(kind, value), shaped).otherwise(-1),
        _vote(*listed),
        _vote(around.rlike(NEAR[kind]), F.lower(c["before"]).rlike(AGAINST)),
    ]


def _shape(value: Column) -> Column:
    """Whether the value is one unbroken run."""
    return (~value.rlike("[ ().]")).cast("int")


def _labeled(k: int, strict: bool):
    kind = KINDS[k]
    return lambda c: F.struct(
        F.lit(k).alias("kind"),
        F.lit(strict).alias("strict"),
        c["start"].alias("start"),
        c["stop"].alias("stop"),
        _passes(kind, c["value"]).alias("passes"),
        F.array(*_votes(kind, c, strict)).alias("votes"),
        _shape(c["value"]).alias("shape"),
    )


def candidates(text: Column) -> Column:
    """Array of (kind, strict, start, stop, passes, votes, shape), kind being an index of KINDS."""
    none = F.array().cast("array<struct<kind:int,strict:boolean,start:int,stop:int,passes:boolean,votes:array<int>,shape:int>>")
    out = []
    for k, kind in enumerate(KINDS):
        for strict, patterns, hints in ((True, STRICT, HINT), (False, LOOSE, LOOSE_HINT)):
            if kind in patterns:
                worth = text.rlike(hints[kind]) & text.rlike(patterns[kind])
                found = F.when(worth, _matches(text, patterns[kind]))
                out.append(F.coalesce(F.transform(found, _labeled(k, strict)), none))
    return F.concat(*out)


def reliabilities(counts: dict[tuple[int, ...], float], known: dict[tuple[int, ...], float] | None = None, prior: list | None = None) -> tuple[list, dict]:
    """Expectation-maximisation over counts of votes: by labeler and vote its rates on true and false candidates; posteriors.

    ``known`` gives the votes whose truth is settled. ``prior`` gives the rates to begin with, which
    count as four candidates of either sort; without it a labeler is taken to be right three times
    in four. An abstention says nothing.
    """
    known = known or {}
    width = len(next(iter(counts), ()))
    rel = prior or [{0: (1.0, 1.0), 1: (0.75, 0.25), -1: (0.25, 0.75)}] * width
    start, share = rel, 0.5
    open_ = {v: n for v, n in counts.items() if v not in known}
    post = dict(known)
    for _ in range(ROUNDS):
        for v in open_:
            odds = math.log(share / (1 - share)) + sum(math.log(rel[j][x][0] / rel[j][x][1]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        share = (sum(n * post[v] for v, n in open_.items()) + 1) / (sum(open_.values()) + 2)
        rel = []
        for j in range(width):
            sums = {x: [4 * start[j][x][0], 4 * start[j][x][1]] for x in (1, -1)}
            for v, n in counts.items():
                if v[j]:
                    sums[v[j]][0] += n * post[v]
                    sums[v[j]][1] += n * (1 - post[v])
            yes, no = (sums[1][i] + sums[-1][i] for i in (0, 1))
            rel.append({0: (1.0, 1.0)} | {x: (max(s[0] / yes, 1e-6), max(s[1] / no, 1e-6)) for x, s in sums.items()})
    return rel, post


def _settled(kind: int, counts: dict) -> dict[tuple[int, ...], float]:
    """The truth that the first labeler's vote settles; for kinds without a strict pattern only what is false."""
    return {v: float(v[0] > 0) for v in counts if v[0] < 0 or v[0] > 0 and KINDS[kind] in STRICT}


def _by_votes(counts: dict) -> dict[tuple[int, ...], float]:
    out: dict[tuple[int, ...], float] = {}
    for (votes, _), n in counts.items():
        out[votes] = out.get(votes, 0) + n
    return out


class Classifier:
    """Labelers' reliabilities and the weights of the span classifier."""

    def __init__(self, counts: dict[tuple[int, tuple[int, ...], int], int]) -> None:
        self.reliability: dict[int, list[dict[int, tuple[float, float]]]] = {}
        self.weights: dict[int, list[float]] = {}
        by_kind: dict[int, dict] = {}
        for (kind, votes, shape), n in counts.items():
            by_kind.setdefault(kind, {})[votes, shape] = n
        # Every kind has the same say in what all of them teach; secrets' first labeler is of another sort.
        pooled: dict[tuple[int, ...], float] = {}
        for kind, own in by_kind.items():
            votes = _by_votes(own)
            scale = 10 * math.log1p(sum(votes.values())) / sum(votes.values())
            for v, n in votes.items():
                if KINDS[kind] in STRICT:
                    pooled[v] = pooled.get(v, 0) + n * scale
        self.shared = reliabilities(pooled, _settled(0, pooled))[0] if pooled else None
        for kind, own in by_kind.items():
            self._fit(kind, own)

    def _fit(self, kind: int, counts: dict) -> None:
        votes = _by_votes(counts)
        shared = self.shared
        if shared and KINDS[kind] not in STRICT:
            shared = [{0: (1.0, 1.0), 1: (0.75, 0.25), -1: (0.25, 0.75)}, *shared[1:]]
        self.reliability[kind], post = reliabilities(votes, _settled(kind, votes), shared)
        # A pattern weighs the log of its count, so that common ones don't drown rare ones.
        weight = sum(math.log1p(n) for n in counts.values())
        rows = [(self.features(votes, shape), math.log1p(n) / weight, post[votes]) for (votes, shape), n in counts.items()]
        w = [0.0] * len(rows[0][0])
        for _ in range(1500):
            slope = [1e-4 * x for x in w]
            for x, n, y in rows:
                off = n * (1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(w, x)))))) - y)
                for i, b in enumerate(x):
                    slope[i] += off * b
            w = [a - 2.0 * s for a, s in zip(w, slope)]
        self.weights[kind] = w

    @staticmethod
    def features(votes: tuple[int, ...], shape: int) -> list[float]:
        return [1.0, float(shape), *(float(v == 1) for v in votes), *(float(v == -1) for v in votes)]

    def accepts(self, c: Column) -> Column:
        """Whether the classifier takes a candidate."""
        limit = math.log(THRESHOLD / (1 - THRESHOLD))
        out = F.lit(False)
        for kind, w in self.weights.items():
            n = (len(w) - 2) // 2
            score = F.lit(w[0]) + w[1] * c["shape"]
            for j in range(n):
                score += F.when(c["votes"][j] == 1, w[2 + j]).when(c["votes"][j] == -1, w[2 + n + j]).otherwise(0.0)
            # A loose candidate that fails its kind's check is no instance of the kind.
            out = F.when(c["kind"] == kind, (score >= limit) & c["passes"]).otherwise(out)
        return out


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the column ``_candidates``; null texts have none."""
    return df.withColumn("_candidates", candidates(F.coalesce(F.col(text), F.lit(""))))


def fit(df: DataFrame, text: str = "text") -> Classifier:
    """Learn from the candidates of all rows; what is collected are the counts of vote patterns."""
    df = df if "_candidates" in df.columns else with_candidates(df, text)
    one = df.select(F.explode("_candidates").alias("c"))
    rows = one.groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n")).collect()
    return Classifier({(r["kind"], tuple(r["votes"]), r["shape"]): r["n"] for r in rows})


def find(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (start, kind, stop) in order of start, then kind.

    Candidates are taken from the column ``_candidates``, where there is one.
    """
    mine = df if "_candidates" in df.columns else with_candidates(df, text)
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))
    base = F.transform(F.filter("_candidates", lambda c: c["strict"] & c["passes"]), span)
    mine = mine.withColumn("base", F.sort_array(base))
    overlaps = lambda b, c: (b["start"] < c["stop"]) & (c["start"] < b["stop"])
    hull = lambda own: F.struct(F.array_min(F.transform(own, lambda b: b["start"])).alias("start"), F.array_max(F.transform(own, lambda b: b["stop"])).alias("stop"), own.alias("own"))
    # A block of base spans is looked into only where its hull overlaps.
    free = lambda hulls, c: ~F.exists(hulls, lambda h: overlaps(h, c) & F.exists(h["own"], lambda b: overlaps(b, c)))
    accepted = F.filter("_candidates", lambda c: ~c["strict"] & model.accepts(c))
    more = _let(F.transform(_blocks(F.col("base")), hull), lambda hulls: F.filter(accepted, lambda c: free(hulls, c)))
    spans = F.sort_array(F.concat("base", F.transform(more, span)))
    return mine.withColumn("spans", spans).drop("_candidates")


def spelled(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def redact(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``df`` with each span of the text replaced by its kind in brackets, as ``[EMAIL]``.

    Of overlapping spans the first names the replacement and all are removed.
    """
    found = find(df, model, text)
    source = F.col(text)
    none = F.array().cast("array<string>")
    name = lambda x: F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1))

    def replaced(block: Column, at: Column) -> Column:
        """The text from ``at`` to the last of the block's spans that begins beyond it, spans replaced."""
        window = F.substring(source, at + 1, F.greatest(F.array_max(F.transform(block, lambda x: x["start"])) - at, F.lit(0)))

        def put(w: Column):
            def add(s: Column, x: Column) -> Column:
                kept = F.substring(w, s["at"] - at + 1, x["start"] - s["at"])
                fresh = F.concat(s["out"], F.array(kept, F.concat(F.lit("["), name(x), F.lit("]"))))
                return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

            return F.array_join(F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), add)["out"], "")

        return _let(window, put)

    def redacted(blocks: Column) -> Column:
        upto = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["stop"])))
        # The furthest end of all spans before each block, and of all.
        reach = lambda s, x: F.array_append(s, F.greatest(x, F.element_at(s, -1)))
        starts = F.aggregate(upto, F.array(F.lit(0)), reach)
        return _let(starts, lambda at: F.concat(
            F.array_join(F.zip_with(blocks, F.slice(at, F.lit(1), F.size(blocks)), replaced), ""),
            F.substring(source, F.element_at(at, -1) + 1, F.char_length(source)),
        ))

    done = _let(_blocks(F.col("spans")), redacted)
    return found.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(source)).drop("base", "spans")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = with_candidates(runtime.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_candidates")
    docs = runtime.checkpoint(docs)  # learned from and judged without reading the texts again
    found = find(docs, fit(docs))
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [counted(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS) if kind in STRICT]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
