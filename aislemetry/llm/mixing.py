"""Mixing to target weights by soft domain membership, with DataFrame operations only.

A naive-Bayes classifier over binned document statistics, fitted on a bounded sample of the `labels` table, gives
every document a posterior over the domains quality x toxic. Nonnegative document rates r then minimise

    1/2 sum_d ((sum_i p_id t_i r_i - T_d) / T)^2  +  ridge/2 sum_i t_i / T (r_i - 1)^2

for token counts t, posteriors p, and target totals T_d that add up to T. Projected gradient steps with momentum are
taken in the metric t_i / T, where one rate depends on its document's posterior only. A posterior depends on the bins
only, so tokens are first summed per vector of bins, at most 7 * 7 * 9 * 8 * 7 * 5 = 123,480 sums whatever the input. One
task takes all steps over an array of them until the duality gap shows that every total is within `PART` of the least
target of the optimum's, and the documents meet the exact posteriors and rates by a broadcast of those groups.
`totals` gives the reached totals beside the targets.

Copies of a document are its rate's whole part plus one with the probability of the rest, drawn by a content hash, so
a repeated run gives the same corpus.

Defined results: a null or empty text has zero tokens and the posterior of its statistics; equal rows get equal rates
and copies; without documents the result is empty; without usable labels posteriors are uniform; a label with a null
is not used; input columns named like an output are replaced by it.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislemetry.llm.common import field_name, sampled
from aislemetry.session import cut

DOMAINS = ("poor", "poor_toxic", "good", "good_toxic")        # index: 2 * quality + toxic
TARGET = {"poor": 0.02, "poor_toxic": 0.01, "good": 0.95, "good_toxic": 0.02}
SAMPLE = 20_000             # labelled documents that the classifier is fitted on, at most
LEXICON = 64                # words that tell toxic from other labelled documents
STEPS = 500                 # gradient steps of one job
ROUNDS = 40                 # jobs until a fit that is still short of its tolerance is an error
RIDGE = 1e-4
PART = 1e-3                 # of the least target: how far a total may be from the optimum's

#: Bin edges of the statistics, natural logs of 1 + x for counts.
EDGES = {
    "log_words": [2.4, 3.5, 4.5, 5.5, 6.5, 7.5],
    "word_length": [3.5, 4.5, 5.5, 6.5, 8.0, 10.0],
    "distinct": [0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8],
    "symbols": [0.0005, 0.002, 0.01, 0.03, 0.06, 0.1, 0.2],
    "capitals": [0.005, 0.02, 0.05, 0.1, 0.3, 0.5],
    "told": [0.5, 1.5, 2.5, 4.5],
}
_SYMBOLS = "[#*$%&|<>!]"
_CAPITALS = "[A-Z]"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda's variable is never expanded by the optimiser."""
    return F.element_at(F.transform(F.array(value), use), 1)


def statistics(text: Column, lexicon: list[str]) -> Column:
    """Struct of the document statistics and the word count `words`."""
    body = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\n"), F.lit(" "))

    def of(x: Column) -> Column:
        body, split = x["body"], x["split"]
        gaps = F.size(split) - 1
        split = F.array_remove(split, "")
        chars = F.length(body)
        symbols = chars - F.length(F.regexp_replace(body, _SYMBOLS, ""))
        capitals = chars - F.length(F.regexp_replace(body, _CAPITALS, ""))
        told = F.size(F.array_intersect(F.split(F.lower(body), "[ \t]"), F.lit(lexicon))) if lexicon else F.lit(0)

        def counted(w: Column) -> Column:
            words, n = w["n"], F.greatest(w["n"], F.lit(1))
            return F.struct(
                words.cast("long").alias("words"), F.log1p(words.cast("double")).alias("log_words"),
                ((chars - gaps) / n).alias("word_length"), (w["distinct"] / n).alias("distinct"),
                (symbols / F.greatest(chars, F.lit(1))).alias("symbols"),
                (capitals / F.greatest(chars, F.lit(1))).alias("capitals"), told.cast("double").alias("told"))

        return bound(F.struct(F.size(split).alias("n"), F.size(F.array_distinct(split)).alias("distinct")), counted)

    return bound(body, lambda b: bound(F.struct(b.alias("body"), F.split(b, "[ \t]").alias("split")), of))


def _bin(stat: Column, name: str) -> Column:
    return sum(((stat[name] >= edge).cast("int") for edge in EDGES[name]), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, sample: int) -> DataFrame:
    """(body, domain) of about `sample` labelled documents, picked by a hash of the label's id.

    The picked labels are at most `sample` rows of two numbers, a size that the parameter bounds, and are broadcast.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("__id"),
                           (2 * F.col("quality") + F.col("toxic")).cast("int").alias("domain")) \
        .where("__id is not null and domain between 0 and 3")
    picked = sampled(usable, F.col("__id"), sample)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body")) \
        .join(F.broadcast(picked), "__id").drop("__id")


def lexicon_of(labelled: DataFrame, size: int) -> list[str]:
    """The lower-cased words whose presence most favours toxic documents, by smoothed log odds of document counts."""
    totals = labelled.agg(F.count_if(F.expr("domain in (1, 3)")).alias("t"), F.count_if(F.expr("domain in (0, 2)")).alias("o")).first()
    if not totals["t"]:
        return []
    words = F.split(F.lower(F.replace("body", F.lit("\n"), F.lit(" "))), "[ \t]")
    seen = (labelled.select("domain", F.explode(F.array_distinct(words)).alias("word"))
            .where("word <> ''").groupBy("word")
            .agg(F.count_if(F.expr("domain in (1, 3)")).alias("t"), F.count_if(F.expr("domain in (0, 2)")).alias("o")).where("t >= 3"))
    odds = F.log((F.col("t") + 0.5) / (totals["t"] + 1)) - F.log((F.col("o") + 0.5) / (totals["o"] + 1))
    top = seen.withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt("t")), "word")
    return [r["word"] for r in top.limit(size).collect()]


def fit(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", sample=SAMPLE, lexicon=LEXICON) -> dict:
    """Lexicon, log priors and log likelihood tables; the driver gets one count per statistic, bin and domain."""
    labelled = cut(labelled_sample(docs, labels, text, doc_id, sample))
    told = lexicon_of(labelled, lexicon)
    seen = bound(statistics(F.col("body"), told), lambda s: F.array(
        *[F.struct(F.lit(f).alias("f"), _bin(s, f).alias("bin")) for f in EDGES],
        F.struct(F.lit("").alias("f"), F.lit(0).alias("bin"))))
    rows = labelled.select("domain", F.explode(seen).alias("x")).groupBy("domain", "x.f", "x.bin").count().collect()
    n = {d: 1.0 for d in range(len(DOMAINS))}
    n.update({r["domain"]: r["count"] + 1.0 for r in rows if r["f"] == ""})
    table = {f: [[0.5] * (len(edges) + 1) for _ in DOMAINS] for f, edges in EDGES.items()}
    for r in rows:
        if r["f"]:
            table[r["f"]][r["domain"]][r["bin"]] += r["count"]
    logs = {f: [[math.log(x / sum(row)) for x in row] for row in per_domain] for f, per_domain in table.items()}
    return {"lexicon": told, "prior": [math.log(n[d] / sum(n.values())) for d in range(len(DOMAINS))], "logs": logs}


def vector(stat: Column) -> Column:
    """One number for the bins of all statistics."""
    code = F.lit(0)
    for name, edges in EDGES.items():
        code = code * (len(edges) + 1) + _bin(stat, name)
    return code


def membership(text: Column, model: dict) -> Column:
    """Struct of n_tokens and the vector of bins, on which alone the posterior depends."""
    return bound(statistics(text, model["lexicon"]), lambda s: F.struct(s["words"].alias("n_tokens"),
                                                                        vector(s).alias("bins")))


def posterior(bins: Column, model: dict) -> Column:
    """Exact posteriors by `DOMAINS` of a vector of bins."""
    domains, at, below = range(len(DOMAINS)), {}, 1
    for name, edges in reversed(EDGES.items()):
        at[name] = (F.floor(bins / below) % (len(edges) + 1) + 1).cast("int")
        below *= len(edges) + 1
    log = F.array(*[sum((F.element_at(F.lit(model["logs"][f][d]), at[f]) for f in EDGES), F.lit(model["prior"][d]))
                    for d in domains])
    return bound(log, lambda log: bound(
        F.transform(log, lambda x: F.exp(x - F.array_max(log))),
        lambda e: F.transform(e, lambda x: x / sum((e[d] for d in domains), F.lit(0.0)))))


def _step(s: Column, groups: Column, wanted: list[float], ridge: float) -> Column:
    """One gradient step of the state `s`, and the duality gap of the rates that it makes."""
    domains = range(len(DOMAINS))
    e = [s["ahead"][d] - F.lit(wanted[d]) for d in domains]

    def sloped(g: Column, y: Column) -> Column:
        slope = sum((g["p"][d] * e[d] for d in domains), F.lit(0.0))
        return F.struct(g["p"].alias("p"), g["w"].alias("w"), y.alias("y"), slope.alias("slope"))

    def moved(g: Column, old: Column) -> Column:
        new = F.greatest(F.lit(0.0), g["y"] - (g["slope"] + ridge * (g["y"] - 1.0)) / (1.0 + ridge))
        return F.struct(g["p"].alias("p"), g["w"].alias("w"), g["y"].alias("y"), g["slope"].alias("slope"),
                        old.alias("old"), new.alias("new"))

    def add(acc: Column, m: Column) -> Column:
        # The least of the dual's own rates, slope * x + ridge / 2 (x - 1)^2 over x >= 0.
        dual = F.when(m["slope"] < ridge, m["slope"] - m["slope"] * m["slope"] / (2 * ridge)).otherwise(ridge / 2)
        return F.struct(
            F.array(*[acc["made"][d] + m["w"] * m["new"] * m["p"][d] for d in domains]).alias("made"),
            (acc["away"] + m["w"] * (m["new"] - 1.0) * (m["new"] - 1.0)).alias("away"),
            (acc["dual"] + m["w"] * dual).alias("dual"),
            (acc["turn"] + m["w"] * (m["y"] - m["new"]) * (m["new"] - m["old"])).alias("turn"))

    def state(m: Column, sums: Column) -> Column:
        miss = [sums["made"][d] - F.lit(wanted[d]) for d in domains]
        primal = sum((x * x for x in miss), F.lit(0.0)) / 2 + ridge / 2 * sums["away"]
        dual = sums["dual"] - sum((x * (x / 2 + wanted[d]) for d, x in enumerate(e)), F.lit(0.0))
        # Momentum starts anew where it points uphill.
        following = F.when(sums["turn"] > 0, 1.0).otherwise((1.0 + F.sqrt(1.0 + 4.0 * s["theta"] * s["theta"])) / 2)
        push = F.when(sums["turn"] > 0, 0.0).otherwise((s["theta"] - 1.0) / following)
        return bound(push, lambda b: F.struct(
            F.transform(m, lambda x: x["new"]).alias("r"),
            F.transform(m, lambda x: x["new"] + b * (x["new"] - x["old"])).alias("y"),
            F.array(*[sums["made"][d] + b * (sums["made"][d] - s["made"][d]) for d in domains]).alias("ahead"),
            sums["made"].alias("made"), following.alias("theta"), (primal - dual).alias("gap")))

    zero = F.struct(F.array(*[F.lit(0.0) for _ in domains]).alias("made"), F.lit(0.0).alias("away"),
                    F.lit(0.0).alias("dual"), F.lit(0.0).alias("turn"))
    return bound(F.zip_with(F.zip_with(groups, s["y"], sloped), s["r"], moved),
                 lambda m: bound(F.aggregate(m, zero, add), lambda sums: state(m, sums)))


def solve(groups: DataFrame, target: dict, ridge=RIDGE, part=PART) -> DataFrame:
    """`key`, `p` and the fitted `rate` of groups (key, p, t tokens), whose number must be bounded.

    The steps run inside one task over an array of the groups, and end when no total can differ from the optimum's
    by more than `part` of the least target: half the square of that distance is at most the duality gap.
    """
    groups = cut(groups)
    total = groups.agg(F.sum("t")).first()[0]
    if not total:
        return groups.select("key", "p", F.lit(1.0).alias("rate"))
    weight = sum(target.values())
    wanted = [target[d] / weight for d in DOMAINS]
    enough = (part * min(w for w in wanted if w > 0)) ** 2 / 2
    made = [F.sum(F.col("p")[d] * F.col("t") / F.lit(float(total))) for d in range(len(DOMAINS))]
    one = F.transform("g", lambda g: F.lit(1.0))
    # Sorted, so that a repeated run adds in the same order.
    now = cut(groups.agg(F.sort_array(F.collect_list(F.struct(
        "key", "p", (F.col("t") / F.lit(float(total))).alias("w")))).alias("g"), F.array(*made).alias("made"))
        .select("g", F.struct(one.alias("r"), one.alias("y"), F.col("made").alias("ahead"), F.col("made").alias("made"),
                              F.lit(1.0).alias("theta"), F.lit(math.inf).alias("gap")).alias("s")))
    gap = math.inf
    for _ in range(ROUNDS):
        now = cut(now.select("g", F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)), F.col("s"),
            lambda s, _: F.when(s["gap"] <= enough, s).otherwise(_step(s, F.col("g"), wanted, ridge))).alias("s")))
        gap = now.select("s.gap").first()[0]
        if gap <= enough:
            break
    else:
        raise ArithmeticError(f"duality gap {gap} after {ROUNDS * STEPS} steps, wanted {enough}")
    return cut(now.select(F.explode(F.zip_with("g", "s.r", lambda g, r: F.struct(
        g["key"].alias("key"), g["p"].alias("p"), r.alias("rate")))).alias("x")).select("x.*"))


def mix(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", target=None, sample=SAMPLE,
        ridge=RIDGE, keep=None) -> DataFrame:
    """The `keep` columns (default: all) of every row with n_tokens, p (posterior by `DOMAINS`), rate and copies.

    Memberships are computed once and written to reliable storage with the kept columns; the steps of the fit and the
    result read that.
    """
    own = docs.drop("n_tokens", "p", "rate", "copies")
    model = fit(own, labels, text, doc_id, sample)
    kept = [c for c in (keep or own.columns) if c in own.columns]
    member, chance, fit_ = (field_name(own, name) for name in ("__member", "__chance", "__fit"))
    draw = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(1 << 30)) / float(1 << 30)
    scored = cut(own.select(*[F.col(f"`{c}`") for c in kept], draw.alias(chance),
                            membership(F.col(f"`{text}`"), model).alias(member)))
    groups = scored.groupBy(F.col(member)["bins"].alias("key")).agg(F.sum(F.col(member)["n_tokens"]).alias("t"))
    rates = solve(groups.select("key", posterior(F.col("key"), model).alias("p"), "t"), target or TARGET, ridge)
    # At most as many rows as there are vectors of bins.
    met = scored.join(F.broadcast(rates.select(F.struct("key", "p", "rate").alias(fit_))),
                      F.col(member)["bins"] == F.col(fit_)["key"])
    fitted = met.select(*[F.col(f"`{c}`") for c in kept], F.col(member)["n_tokens"].alias("n_tokens"),
                        F.col(fit_)["p"].alias("p"), F.col(fit_)["rate"].alias("rate"), chance)
    return fitted.withColumn("copies", (F.floor("rate") + (F.col(chance) < F.col("rate") - F.floor("rate")).cast(
        "long")).cast("long")).drop(chance)


def totals(mixed: DataFrame, target=None) -> DataFrame:
    """domain, target and reached share of all tokens at the rates of `mix`, and the share that the copies make."""
    target = target or TARGET
    weight = sum(target.values())
    all_tokens = F.greatest(F.sum("n_tokens"), F.lit(1))
    shares = [F.struct(F.lit(name).alias("domain"), F.lit(target[name] / weight).alias("target"),
                       *[(F.sum(F.col("p")[d] * F.col("n_tokens") * F.col(by)) / all_tokens).alias(label)
                         for by, label in (("rate", "reached"), ("copies", "copied"))])
              for d, name in enumerate(DOMAINS)]
    return mixed.agg(F.array(*shares).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def apply(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", target=None, **options) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with the columns of `docs`."""
    inner = field_name(docs, "__row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(inner),
                         F.col(f"`{text}`").alias("__text"), F.col(f"`{doc_id}`").alias("__doc"))
    mixed = mix(packed, labels, "__text", "__doc", target, keep=(inner,), **options)
    taken = mixed.where("copies > 0").select(inner, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(inner).getField(c).alias(c) for c in docs.columns])
