"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

Everything is DataFrame functions. URLs that a rule fits are the labelled ones; the trees learn from a bounded sample of them
(``SAMPLE`` of each verdict, those with the smallest hash of id and URL) and judge all others. Features: lengths of URL, host,
path and query, depth, labels of the host, hyphens, digit ratios, entropy of the characters, counts of parameters and
escapes, and suffix statistics: how many labelled URLs share the host's last one, two or three labels and how many of those
are blocked, over all labelled rows. Suffixes are counted in ``BUCKETS`` hashed buckets, so that table has a fixed size
however many hosts there are and is broadcast; suffixes that fall into one bucket share their figures. Both verdicts weigh
the same in rates and in training, however unequal their counts, so that a URL like none of the labelled ones is not judged
by which verdict is the more frequent.

Training is second-order boosting of logistic loss on binned features (edges: exact percentiles of the sample). Rows with
equal bins are one row with a weight. Each level of a tree is one aggregate by (node, feature, bin), whose size depends on
parameters only; the driver picks splits from it. Gradients are rounded to 2**-20 and summed as integers, so the trees do
not depend on how rows are spread. A tree is a CASE expression, and scoring is one projection.

Defined cases: a null URL, and one without "://", have an empty host and path and the features of the text there is (null:
empty); without labelled rows every URL that no rule fits is allowed; where all labelled rows have one verdict, that is the
verdict; repeated rows each get a row; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

#: (verdict, host, path); a rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Labelled rows of each verdict that trees are trained on.
SAMPLE = 32768
#: Hashed buckets of suffix statistics, for each number of labels.
BUCKETS = 4096
#: Labelled rows of the rate 0.5 that are added to each suffix's own.
SMOOTH = 20.0
#: Gradients, and weights of rows, are integers in these units.
UNIT, WEIGHT = 1 << 20, 1 << 8

LEXICAL = ["url_length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "escapes"]
#: Last labels of a host that statistics are kept for.
DEPTHS = (1, 2, 3)
SUFFIX = [f"suffix{n}_{what}" for n in DEPTHS for what in ("rate", "count")]
FEATURES = LEXICAL + SUFFIX


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character: characters are sorted and runs of equal ones summed up, so long texts take n log n steps."""
    log = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(state: Column, char: Column) -> Column:
        same = state["last"] == char
        return F.struct(char.alias("last"), F.when(same, state["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, state["sum"]).otherwise(state["sum"] + log(state["run"])).alias("sum"))

    size = F.length(text).cast("double")
    total = F.aggregate(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), start, step, lambda s: s["sum"] + log(s["run"]))
    return F.when(size > 0, F.log2(size) - total / size).otherwise(0.0)


def parsed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, query, rule and given: the verdict of the longest rule that fits, or null."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    out = pages.select("page_id", url.alias("url")).withColumn("rest", F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = out.withColumns({"host": F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), upper, upper.lower()), "path": F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1), "query": F.regexp_extract("rest", r"^[^?#]*\?([^#]*)", 1)})
    rule = verdict = F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda x: (len(x[1] + x[2]), x[1:])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return out.drop("rest").withColumns({"rule": rule, "given": verdict})


def _suffixes(urls: DataFrame) -> DataFrame:
    """bucket1, bucket2, ...: the hashed last labels of the host."""
    bucket = lambda n: F.pmod(F.xxhash64(F.substring_index("host", ".", -n)), F.lit(BUCKETS)).cast("int")
    return urls.withColumns({f"bucket{n}": bucket(n) for n in DEPTHS})


def _suffix_counts(labelled: DataFrame) -> list[DataFrame]:
    """For each number of labels: bucket, count and how many are blocked; at most BUCKETS rows each, written."""
    rows = _suffixes(labelled)
    return [_store.stored(rows.groupBy(f"bucket{n}").agg(F.count("*").alias("n"), F.count(F.when(F.col("given") == "block", 1)).alias("blocked")), "url-suffixes") for n in DEPTHS]


def _weights(blocked: int, allowed: int) -> tuple[float, float]:
    """Weights of a blocked and of an allowed row: both verdicts together weigh as much as all rows, each one half."""
    return (blocked + allowed) / (2 * max(blocked, 1)), (blocked + allowed) / (2 * max(allowed, 1))


def _suffix_rates(counted: Sequence[DataFrame], weights: tuple[float, float]) -> list[DataFrame]:
    block, allow = F.col("blocked") * weights[0], (F.col("n") - F.col("blocked")) * weights[1]
    return [t.select(f"bucket{n}", F.log1p("n").alias(f"suffix{n}_count"), ((block + SMOOTH / 2) / (block + allow + SMOOTH)).alias(f"suffix{n}_rate")) for n, t in zip(DEPTHS, counted)]


def features(urls: DataFrame, suffixes: Sequence[DataFrame]) -> DataFrame:
    """Parsed URLs with the columns of ``FEATURES``; suffixes never seen in a labelled row have no count and the rate 0.5."""
    length = lambda c: F.length(c).cast("double")
    ratio = lambda c: F.when(F.length(c) > 0, _count(F.col(c), "[0-9]") / F.length(c)).otherwise(0.0)
    own = {
        "url_length": length("url"), "host_length": length("host"), "path_length": length("path"), "query_length": length("query"),
        "depth": _count(F.col("path"), "/[^/]"), "labels": _count(F.col("host"), r"[^.]+"), "hyphens": _count(F.col("host"), "-"), "digit_ratio": ratio("url"), "host_digit_ratio": ratio("host"),
        "entropy": _entropy(F.col("url")), "parameters": _count(F.col("query"), "[^&]+"), "escapes": _count(F.col("url"), "%[0-9A-Fa-f]{2}"),
    }
    out = _suffixes(urls)
    for n, table in zip(DEPTHS, suffixes):
        out = out.join(F.broadcast(table), f"bucket{n}", "left")  # BUCKETS rows at most
        own |= {f"suffix{n}_count": F.coalesce(f"suffix{n}_count", F.lit(0.0)), f"suffix{n}_rate": F.coalesce(f"suffix{n}_rate", F.lit(0.5))}
    return out.withColumns(own).drop(*[f"bucket{n}" for n in DEPTHS])


@dataclass(frozen=True)
class Split:
    feature: int
    #: Rows whose bin is at most this one go left.
    bin: int
    left: Split | float
    right: Split | float


@dataclass(frozen=True)
class Trees:
    names: list[str]
    edges: list[list[float]]
    trees: list[Split | float]

    def margin(self) -> Column:
        """Log-odds of "block" as an expression over the feature columns."""

        def node(tree: Split | float) -> Column:
            if not isinstance(tree, Split):
                return F.lit(tree)
            return F.when(F.col(self.names[tree.feature]) <= self.edges[tree.feature][tree.bin], node(tree.left)).otherwise(node(tree.right))

        return sum((node(t) for t in self.trees), F.lit(0.0))


def _binned(df: DataFrame, names: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """b0, b1, ...: for each feature how many edges lie below the value."""
    return df.select("y", *[sum(((F.col(c) > e).cast("int") for e in own), F.lit(0)).alias(f"b{k}") for k, (c, own) in enumerate(zip(names, edges))])


def _tree_on_bins(tree: Split | float) -> Column:
    if not isinstance(tree, Split):
        return F.lit(tree)
    return F.when(F.col(f"b{tree.feature}") <= tree.bin, _tree_on_bins(tree.left)).otherwise(_tree_on_bins(tree.right))


def grow(histogram: dict, nodes: Sequence[int], bins: Sequence[int], ridge: float, least: int) -> dict[int, tuple[int, int] | None]:
    """The best (feature, bin) of each node, or None: largest gain, ties to the first feature and bin.

    histogram[node, feature, bin] is (gradient, curvature, rows); ``bins`` has the number of bins of each feature."""
    chosen, one = {}, UNIT * WEIGHT
    for node in nodes:
        total = [sum(histogram.get((node, 0, b), (0, 0, 0))[k] for b in range(bins[0])) for k in range(3)]
        score = lambda g, h: (g / one) ** 2 / (h / one + ridge)
        best, found = 1e-6, None
        for f, n in enumerate(bins):
            g = h = rows = 0
            for b in range(n - 1):
                own = histogram.get((node, f, b), (0, 0, 0))
                g, h, rows = g + own[0], h + own[1], rows + own[2]
                if rows < least or total[2] - rows < least:
                    continue
                gain = score(g, h) + score(total[0] - g, total[1] - h) - score(total[0], total[1])
                if gain > best + 1e-9:
                    best, found = gain, (f, b)
        chosen[node] = found
    return chosen


def train(rows: DataFrame, names: Sequence[str] = FEATURES, trees: int = 12, depth: int = 3, rate: float = 0.4, bins: int = 16, ridge: float = 1.0, least: int = 20) -> Trees:
    """Fit trees to ``rows``: feature columns and y (0 or 1). The rows should be a bounded sample: edges are their exact percentiles.

    ``least``: rows on either side of a split, at least. Nothing but tables of (nodes x features x bins) reaches the driver."""
    spark = rows.sparkSession
    cuts = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile(c, F.array(*map(F.lit, cuts))).alias(c) for c in names]).first()
    edges = [sorted(set(found[c] or [])) for c in names]
    grouped = _binned(rows, names, edges).groupBy(*[f"b{k}" for k in range(len(names))]).agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("positive"))
    held = _store.stored(grouped, "url-bins")
    sizes, model, margin = [len(e) + 1 for e in edges], [], F.lit(0.0)
    n, positive = (v or 0 for v in held.agg(F.sum("n"), F.sum("positive")).first())
    block, allow = (round(w * WEIGHT) for w in _weights(positive, n - positive))
    for _ in range(trees):
        # the probability is rounded before it meets the weights: sums of integers are the same in every order
        step = held.withColumn("margin", margin).withColumn("p", F.round(UNIT / (1 + F.exp(-F.col("margin")))).cast("bigint"))
        step = step.withColumns({"w": F.col("positive") * block + (F.col("n") - F.col("positive")) * allow, "c": F.round(F.col("p") * (UNIT - F.col("p")) / UNIT).cast("bigint")})
        step = step.withColumns({"g": F.col("positive") * block * UNIT - F.col("w") * F.col("p"), "h": F.col("w") * F.col("c")})
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {}
        nodes = [1]
        for level in range(depth):
            own = step.withColumn("node", _node(splits, 1)).filter(F.col("node").isin(nodes))
            wide = own.select("node", "g", "h", "n", F.posexplode(F.array(*[f"b{k}" for k in range(len(names))])).alias("feature", "bin"))
            table = wide.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
            histogram = {(r.node, r.feature, r.bin): (r.g, r.h, r.n) for r in table}

            def leaf(node: int, feature: int, kept: Sequence[int]) -> float:
                g, h = (sum(histogram.get((node, feature, b), (0, 0, 0))[k] for b in kept) / (UNIT * WEIGHT) for k in (0, 1))
                return rate * g / (h + ridge)

            following = []
            for node, found in grow(histogram, nodes, sizes, ridge, least).items():
                if found is None:
                    leaves[node] = leaf(node, 0, range(sizes[0]))
                    continue
                splits[node] = (feature, cut) = found
                if level + 1 < depth:
                    following += [2 * node, 2 * node + 1]
                else:
                    leaves |= {2 * node: leaf(node, feature, range(cut + 1)), 2 * node + 1: leaf(node, feature, range(cut + 1, sizes[feature]))}
            nodes = following
            if not nodes:
                break
        model.append(_tree(splits, leaves, 1))
        margin = margin + _tree_on_bins(model[-1])
    _store.remove(held)
    return Trees(list(names), edges, model)


def _node(splits: dict[int, tuple[int, int]], at: int) -> Column:
    if at not in splits:
        return F.lit(at)
    feature, cut = splits[at]
    return F.when(F.col(f"b{feature}") <= cut, _node(splits, 2 * at)).otherwise(_node(splits, 2 * at + 1))


def _tree(splits: dict[int, tuple[int, int]], leaves: dict[int, float], at: int) -> Split | float:
    if at not in splits:
        return leaves.get(at, 0.0)
    return Split(*splits[at], _tree(splits, leaves, 2 * at), _tree(splits, leaves, 2 * at + 1))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE, **settings) -> DataFrame:
    """page_id, host, path, rule, verdict ("allow" or "block") and score, the trees' probability of "block" (null beside a rule)."""
    urls = parsed(pages, rules)
    labelled = urls.filter("given is not null")
    counted = _suffix_counts(labelled)
    n, blocked = (v or 0 for v in counted[0].agg(F.sum("n"), F.sum("blocked")).first())
    if blocked in (0, n):
        return urls.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit("block" if blocked else "allow")).alias("verdict"), F.when(F.col("given").isNull(), float(blocked > 0)).alias("score"))
    suffixes = _suffix_rates(counted, _weights(blocked, n - blocked))
    chance = F.xxhash64(F.col("page_id"), F.col("url"))
    taken = None
    for verdict in ("allow", "block"):
        own = labelled.filter(F.col("given") == verdict).select("page_id", "url", "host", "path", "query", "given").orderBy(chance, "url").limit(sample)
        taken = own if taken is None else taken.unionByName(own)
    rows = features(taken, suffixes).select(*FEATURES, (F.col("given") == "block").cast("int").alias("y"))
    rows = _store.stored(rows, "url-sample")
    model = train(rows, **settings)
    _store.remove(rows)
    scored = features(urls, suffixes).withColumn("score", F.when(F.col("given").isNull(), 1 / (1 + F.exp(-model.margin()))))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
