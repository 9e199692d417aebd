"""Soft-membership mixing of documents to target domain weights, in DataFrame functions only.

A naive Bayes classifier, learned from the labels table, gives every document a posterior
over domains. Nonnegative document rates are then found by projected-gradient least squares
so that the expected token totals of the domains match their targets. A rate depends on its
document only through its posterior and on the few residuals of each step, so a step is one
aggregation that sends a number per domain to the driver; step sizes follow the curvature
that the last step met, and steps are taken until the targets or the optimum are reached.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Target shares of tokens by domain that the queries use.
TARGETS = {"quality=1,toxic=0": 0.9, "quality=0,toxic=0": 0.08, "quality=1,toxic=1": 0.02, "quality=0,toxic=1": 0.0}

WORDS = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class DomainModel:
    """Domains in order, log priors with no word present, and what each feature adds by domain."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    features: dict[str, tuple[float, ...]]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def _shape(text: Column, words: Column) -> Column:
    """Coarse features of a text's form, as strings that no word can equal."""
    n, size = F.size(words), F.greatest(F.length(text), F.lit(1))
    marks = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,]+", ""))
    share = lambda name, x: F.concat(F.lit(f"#{name}:"), F.floor(x).cast("string"))
    return F.array(
        share("words", F.log2(n + 1)), share("marks", F.least(F.lit(20.0), 100 * marks / size)),
        share("distinct", 10 * F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1))), share("letters", F.log2(1 + size / F.greatest(n, F.lit(1)))),
    )


def train_domains(docs: DataFrame, labels: DataFrame, label_cols: tuple[str, ...] = ("quality", "toxic"), max_rows: int = 4000, min_gain: float = 8.0, min_lift: float = 5.0, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Naive Bayes on at most max_rows labelled documents, chosen by a hash of the id.

    A domain is a combination of label values, such as quality=1,toxic=0, however many there
    are. The features kept are the words of the sample with a likelihood ratio of at least
    min_gain (chance seldom gives 8) that one domain has min_lift times as often as the rest,
    and all shape features of the sample. Rows with a null label or id are left out; of
    several rows of an id the one of smallest text hash is learned, once.
    """
    named = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in label_cols])
    known = reduce(lambda d, c: d.where(F.col(c).isNotNull()), label_cols, labels.where(F.col(id_col).isNotNull()))
    picked = known.select(F.col(id_col).cast("long").alias("i"), named.alias("domain")).groupBy("i").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(picked), "i").withColumn("w", _words(F.col("t")))
    each = rows.select("i", "domain", F.struct(F.xxhash64("t").alias("h"), F.array_union(F.array_distinct("w"), F.concat(_shape(F.col("t"), F.col("w")), F.array(F.lit("#")))).alias("f")).alias("x"))
    one = each.groupBy("i", "domain").agg(F.min("x").alias("x"))
    seen = stored(one.select("domain", F.explode("x.f").alias("feature")).groupBy("feature", "domain").agg(F.count("*").alias("n")))
    sizes = {r["domain"]: r["n"] for r in seen.where("feature = '#'").orderBy("domain").collect()}
    domains = tuple(sizes)
    if not domains:
        return DomainModel((), (), {})
    total = sum(sizes.values())
    by = seen.groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"d{k}") for k, d in enumerate(domains)])
    whole = reduce(lambda a, b: a + b, [F.col(f"d{k}") for k in range(len(domains))])
    # G-squared of the feature's spread over the domains against their sizes.
    gain = reduce(lambda a, b: a + b, [F.col(f"d{k}") * F.log((F.col(f"d{k}") + 0.5) * total / ((whole + 0.5) * sizes[d])) for k, d in enumerate(domains)])
    # A word that longer texts merely have more often is no sign of a domain: its share must be several times that elsewhere.
    here = [(F.col(f"d{k}") + 0.5) / (sizes[d] + 1) for k, d in enumerate(domains)]
    away = [(whole - F.col(f"d{k}") + 0.5) / (total - sizes[d] + 1) for k, d in enumerate(domains)]
    lift = F.greatest(*[h / a for h, a in zip(here, away)], F.lit(0.0))
    shape = F.col("feature").startswith("#")
    ranked = by.where(shape & (F.col("feature") != "#")).unionByName(by.where(~shape & (whole >= 3) & (gain >= min_gain) & (lift >= min_lift))).collect()
    features, base = {}, [math.log(sizes[d] / total) for d in domains]
    for r in ranked:
        p = [(r[f"d{k}"] + 0.5) / (sizes[d] + 1) for k, d in enumerate(domains)]
        if r["feature"].startswith("#"):  # one of each kind is always there
            features[r["feature"]] = tuple(math.log(x) for x in p)
        else:  # a word can be absent: that goes to the base, its presence to the feature
            absent = [math.log(1 - min(x, 0.999)) for x in p]
            base = [b + a for b, a in zip(base, absent)]
            features[r["feature"]] = tuple(math.log(x) - a for x, a in zip(p, absent))
    return DomainModel(domains, tuple(base), features)


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text", posterior: str = "posterior", tokens: str = "tokens") -> DataFrame:
    """docs with the posterior (array<double>, by domain) and the number of words of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn(tokens, _words(text))
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    if model.features:
        # Spark looks a key up by going through the map, so features are dealt into small maps by a hash.
        parts = max(1, len(model.features) // 4)
        maps: list[dict] = [{} for _ in range(parts)]
        for f, ll in sorted(model.features.items()):
            maps[zlib.crc32(f.encode()) % parts][f] = ll
        table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,array<double>>>")
        gains = lambda f: F.element_at(F.element_at(table, (F.crc32(f.cast("binary")) % parts + 1).cast("int")), f)
        lexicon = F.from_json(F.lit(json.dumps(sorted(model.features))), "array<string>")
        present = F.concat(F.array_intersect(F.col(tokens), lexicon), F.array_intersect(_shape(text, F.col(tokens)), lexicon))
        score = F.aggregate(present, numbers(model.prior), lambda acc, f: F.zip_with(acc, gains(f), lambda a, b: a + b))
    else:
        score = numbers(model.prior)
    df = df.withColumn(posterior, score).withColumn(tokens, F.size(tokens).cast("long"))
    raised = [F.exp(F.col(posterior)[k] - F.array_max(posterior)) for k in range(len(model.domains))]
    df = df.withColumn(posterior, F.array(*raised).cast("array<double>"))
    total = reduce(lambda a, b: a + b, [F.col(posterior)[k] for k in range(len(model.domains))], F.lit(0.0))
    return df.withColumn(posterior, F.array(*[F.col(posterior)[k] / total for k in range(len(model.domains))]).cast("array<double>"))


def _rate(posterior: Column, steps: list[list[float]], max_rate: float, start: Column | None = None) -> Column:
    """A document's rate after the steps, from start (1): each takes away the residuals' pull and keeps within [0, max_rate]."""

    def step(r: Column, v: list[float]) -> Column:
        pull = reduce(lambda a, b: a + b, [posterior[k] * x for k, x in enumerate(v)])
        return F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), r - pull))

    return reduce(step, steps, F.lit(1.0) if start is None else start)


def fit_rates(
    members: DataFrame, domains: tuple[str, ...], weights: dict[str, float], max_rate: float = 4.0, rounds: int = 100, tolerance: float = 2e-4, settled: float = 2e-6, keep_whole: bool = False, every: int = 8,
) -> tuple[list[list[float]], dict[str, tuple[float, float]]]:
    """Steps of the projected gradient, and (reached, target) expected tokens by domain.

    members has posterior and tokens. Squared residuals are weighted by the inverse of a domain's
    expected tokens, which bounds the curvature by one in the tokens' metric, so a step
    size of one never raises the objective; longer ones follow the curvature along the last step (Barzilai
    and Borwein) and are taken back if the objective exceeds its last four values. The total is that of the
    input, or less where a domain would need a mean
    rate above max_rate. With keep_whole it is set so that the domain of the largest weight
    just stays whole, however scarce the others are: these then give all they have. Stops
    when all domains are within `tolerance` of the total of their targets; or when a step
    changes no domain by more than `settled` of the total, near the optimum: soft memberships can make
    targets contradict each other; or after `rounds`. A step is one scan; rates are stored every
    `every` steps, so expressions stay short.
    """
    k = len(domains)
    if not k:
        return [], {}

    def totals(base: DataFrame, late: list[list[float]]) -> tuple[list[float], float]:
        """Expected tokens after the late steps, and the squared length of the last of them."""
        rows = base.select("posterior", "tokens", _rate(F.col("posterior"), late[:-1], max_rate, F.col("rate")).alias("was"))
        rows = rows.select("posterior", "tokens", "was", _rate(F.col("posterior"), late[-1:], max_rate, F.col("was")).alias("now"))
        row = rows.agg(*[F.sum(F.col("posterior")[d] * F.col("tokens") * F.col("now")).alias(f"s{d}") for d in range(k)], F.sum(F.col("tokens") * (F.col("now") - F.col("was")) ** 2).alias("moved")).first()
        return [row[f"s{d}"] or 0.0 for d in range(k)], row["moved"] or 0.0

    base = members.select("posterior", "tokens", F.lit(1.0).alias("rate"))
    expected, _ = totals(base, [])
    asked = [max(0.0, weights.get(d, 0.0)) if e > 0 else 0.0 for d, e in zip(domains, expected)]
    if not sum(asked):
        return [], {d: (e, e) for d, e in zip(domains, expected)}
    shares = [a / sum(asked) for a in asked]
    if keep_whole:
        top = max(range(k), key=lambda d: shares[d])
        total = expected[top] / shares[top]
    else:
        total = min(sum(expected), *(max_rate * e / s for e, s in zip(expected, shares) if s))
    target = [s * total for s in shares]
    weight = [1 / e if e > 0 else 0.0 for e in expected]
    loss = lambda n: sum(w * (x - t) ** 2 for w, x, t in zip(weight, n, target))
    steps, late, now, size, seen = [], [], expected, 1.0, [loss(expected)]
    for _ in range(rounds):
        if all(abs(n - t) <= tolerance * total for n, t in zip(now, target)):
            break
        pull = [w * (n - t) for w, n, t in zip(weight, now, target)]
        nxt, moved = totals(base, [*late, [size * x for x in pull]])
        if size > 1 and loss(nxt) > max(seen[-4:]):
            size = 1.0
            nxt, moved = totals(base, [*late, pull])
        late.append([size * x for x in pull])
        still = max(abs(a - b) for a, b in zip(nxt, now)) <= settled * total
        bent = sum(w * (a - b) ** 2 for w, a, b in zip(weight, nxt, now))
        size = min(max(moved / bent, 1.0), 1e5) if bent > 0 else 1.0
        now = nxt
        seen.append(loss(now))
        if len(late) >= every:
            base = stored(base.withColumn("rate", _rate(F.col("posterior"), late, max_rate, F.col("rate"))))
            steps, late = steps + late, []
        if still:
            break
    return steps + late, {d: (n, t) for d, n, t in zip(domains, now, target)}


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float = 4.0, rounds: int = 100, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """One row per document: tokens, domain (likeliest), posterior of it, rate, copies, and reached and target, the expected tokens of the domain.

    copies is the rate's whole part, plus one where a hash of id and text falls below its
    fraction. Null and empty texts have no tokens and the posterior of an empty text.
    Repeated rows get the same rate each. Without labels or weights every rate is 1 and the
    domain null. Ties go to the first domain in order. An empty table gives no rows. Other
    columns are not read. Per-document numbers are stored once; no text is shuffled.
    """
    model = train_domains(docs, labels, id_col=id_col, text_col=text_col, **training)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    dice = _dice(F.col("doc_id"), F.col("t")).alias("dice")
    members = stored(with_posteriors(d, model, "t").select("doc_id", "tokens", "posterior", dice))
    steps, ends = fit_rates(members, model.domains, weights, max_rate, rounds)
    rate = _rate(F.col("posterior"), steps, max_rate)
    best = F.array_max("posterior")
    place = F.array_position("posterior", best).cast("int")
    of = lambda values, kind: F.try_element_at(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), place) if values else F.lit(None).cast(kind)
    return members.withColumn("rate", rate).select(
        "doc_id", "tokens", of(model.domains, "string").alias("domain"), best.alias("posterior"), "rate", (F.floor("rate") + (F.col("dice") < F.col("rate") - F.floor("rate")).cast("int")).cast("long").alias("copies"),
        of([ends[d][0] for d in model.domains], "double").alias("reached"), of([ends[d][1] for d in model.domains], "double").alias("target"),
    )


def _dice(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that a document keeps in every run."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], rounds: int = 100, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """docs, all columns, whatever their names, each row kept with its rate as probability.

    Rates are at most 1, so no row is repeated, and the domain of the largest weight is kept
    whole: the others are thinned until they are no more than their shares beside it. Null and
    empty texts have the posterior of an empty text. Repeated rows are kept or go together.
    Without labels or weights all rows are kept. An empty table stays empty.
    """
    model = train_domains(docs, labels, id_col=id_col, text_col=text_col, **training)
    p, n = fresh(docs, "posterior", "tokens")
    full = with_posteriors(docs, model, text_col, p, n)
    members = stored(full.select(F.col(f"`{p}`").alias("posterior"), F.col(f"`{n}`").alias("tokens")))
    steps, _ = fit_rates(members, model.domains, weights, 1.0, rounds, keep_whole=True)
    # A generated column is computed once and cannot be pushed into the filter below, where every step would work it out again.
    once = full.select(*docs.columns, F.explode(F.array(p)).alias(p))
    return once.where(_dice(F.col(id_col), F.col(text_col)) < _rate(F.col(p), steps, 1.0)).drop(p)
