"""The all-pairs self join: classes of units first, then units of classes that can match, then verified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.config import Options
from loomline.functions import metrics as M

#: What all parts of a score but the token similarity depend on. Units alike in these are a class.
SHAPE = ("signature", "sig_len", "struct_sig", "stmt_kinds", "line_count", "has_body", "ret_binop")
#: Lower edges of the line-count blocks, integers since logarithms round.
LINE_EDGES = tuple(3**k for k in range(20))
#: Comparisons of texts that a pair of classes leaves to one share, about: a second's work.
WORK = 1 << 14


def _block(count: Column, edges: tuple[int, ...]) -> Column:
    return sum((F.when(count >= e, 1).otherwise(0) for e in edges), F.lit(0))


def class_key() -> Column:
    return F.sha2(F.to_json(F.struct(*SHAPE)), 256)


def classes(units: DataFrame) -> DataFrame:
    """A row a class: cls, n_units, and the columns of SHAPE."""
    return units.groupBy(class_key().alias("cls")).agg(F.count(F.lit(1)).alias("n_units"), *(F.first(c).alias(c) for c in SHAPE))


def near_classes(shapes: DataFrame, options: Options) -> DataFrame:
    """Pairs of classes, each once and with itself, that agree in their blocks: columns prefixed a_ and b_.

    A line ratio of at most r means neighbouring powers of r, a signature gap of
    at most g neighbouring runs of g + 1 lengths. One side is filed under all
    neighbours; a class of no lines is exempt from the first rule and filed
    everywhere. Classes have no texts, so the copies are small.
    """
    ratio = max(2, int(options.max_line_ratio))
    lines = _block(F.col("line_count"), LINE_EDGES if ratio == 3 else tuple(ratio**k for k in range(20)))
    base = shapes.withColumn("l", lines).withColumn("s", F.floor(F.col("sig_len") / (options.max_signature_gap + 1)).cast("int"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    side = lambda p, *more: [F.col(c).alias(p + c) for c in shapes.columns] + list(more)
    left = base.select(*side(M.A, F.col("l").alias("kl"), F.col("s").alias("ks")))
    right = base.withColumn("kl", F.explode(F.when(F.col("line_count") == 0, F.sequence(F.lit(0), F.lit(len(LINE_EDGES)))).otherwise(F.transform(near, lambda d: F.col("l") + d))))
    right = right.withColumn("ks", F.explode(F.transform(near, lambda d: F.col("s") + d))).select(*side(M.B, F.col("kl"), F.col("ks")))
    # a class of no lines meets the others from the side that is filed everywhere
    none_a, none_b = F.col("a_line_count") == 0, F.col("b_line_count") == 0
    once = F.when(none_a == none_b, F.col("a_cls") <= F.col("b_cls")).otherwise(none_b)
    return left.join(right, ["kl", "ks"]).filter(once & M.may_be_similar(options)).withColumn("rejected", F.lit(False)).drop("kl", "ks")


def all_classes(shapes: DataFrame, options: Options) -> DataFrame:
    """Every pair of classes once, those that cannot be similar marked ``rejected``: what a threshold of 0 asks for."""
    side = lambda p: shapes.select(*(F.col(c).alias(p + c) for c in shapes.columns))
    left = side(M.A).withColumn("salt", F.pmod(F.xxhash64("a_cls"), F.lit(16)))
    right = side(M.B).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    return left.join(right, "salt").filter("a_cls <= b_cls").withColumn("rejected", ~M.may_be_similar(options)).drop("salt")


def candidate_counts(units: DataFrame, options: Options, by: str = "struct_sig") -> DataFrame:
    """Pairs that pass the early rejection, counted by the least and greatest value of a column of SHAPE: classes are paired, units only counted."""
    met = near_classes(classes(units), options)
    n = F.when(F.col("a_cls") == F.col("b_cls"), F.expr("a_n_units * (a_n_units - 1) div 2")).otherwise(F.col("a_n_units") * F.col("b_n_units"))
    return met.groupBy(F.least(f"a_{by}", f"b_{by}").alias("least"), F.greatest(f"a_{by}", f"b_{by}").alias("greatest")).agg(F.sum(n).alias("n")).filter("n > 0")


def score_pairs(units: DataFrame, options: Options | None = None, threshold: float | None = None, cross_file: bool = False, strategy: Callable[[DataFrame, Options], DataFrame] | None = None) -> DataFrame:
    """Pairs ord1 < ord2 with a score of ``threshold`` or more: components, similarity, category.

    ``strategy`` makes the pairs of classes that are compared (a_ and b_ columns
    and ``rejected``): :func:`near_classes`, or at a threshold of 0, where
    rejected pairs match with score 0 too, :func:`all_classes`.
    """
    options = options or Options()
    threshold = options.threshold if threshold is None else threshold
    strategy = strategy or (near_classes if threshold > 0 else all_classes)
    w = options.weights
    met = strategy(classes(units), options)
    met = met.withColumn("tree", M.tree_similarity()).withColumn("structural", M.structural_similarity(options)).withColumn("sig", M.signature_similarity())
    rest = w.tree_edit * F.col("tree") + w.structural * F.col("structural") + w.signature * F.col("sig")
    met = met.select(F.least("a_cls", "b_cls").alias("ca"), F.greatest("a_cls", "b_cls").alias("cb"), F.ceil(F.col("a_n_units") * F.col("b_n_units") / WORK).cast("int").alias("shares"), "tree", "structural", "sig", rest.alias("rest"), "rejected")
    # a key is made once a unit
    own = units.select("ord", "file", "hash", "norm_hash", "token_str", "tok_len", F.explode(F.array(class_key())).alias("cls"))

    def side(rows: DataFrame, p: str, names: tuple[str, ...]) -> list[Column]:
        return [F.col(c).alias(p + c) for c in names]

    exact = (F.col("a_hash") == F.col("b_hash")) | F.coalesce(F.col("a_norm_hash") == F.col("b_norm_hash"), F.lit(False))
    in_order = F.when(F.col("ca") == F.col("cb"), F.col("a_ord") < F.col("b_ord")).otherwise(F.lit(True))
    names = ("ord", "file", "hash", "norm_hash", "token_str", "tok_len")
    # a pair of large classes is shared out; the texts go only where a pair can reach the threshold
    go = met.filter(F.col("rejected") | (F.col("rest") + w.token_similarity >= threshold - M.SLACK))
    left = own.join(go, own["cls"] == go["ca"]).select("ca", "cb", F.pmod(F.xxhash64("ord"), F.col("shares")).cast("int").alias("share"), "tree", "structural", "sig", "rest", "rejected", *side(own, M.A, names))
    right = own.join(go.select("ca", "cb", "shares"), F.col("cls") == F.col("cb")).select("ca", "cb", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), *side(own, M.B, names))
    # by number, so that small inputs of much work are not put into one task
    n_tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["ca", "cb", "share"]
    pairs = left.repartition(n_tasks, *keys).join(right.repartition(n_tasks, *keys), keys).filter(in_order & ~exact)
    m, n = F.col("a_tok_len"), F.col("b_tok_len")
    most = F.when((m == 0) & (n == 0), 1.0).otherwise(F.least(m, n) / F.greatest(m, n, F.lit(1)))
    pairs = pairs.filter(F.col("rejected") | (F.col("rest") + w.token_similarity * most >= threshold - M.SLACK))
    need = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(threshold) - F.col("rest")) / w.token_similarity))
    # exploded, so that the filters below do not compute the distance again
    pairs = pairs.withColumn("tok", F.explode(F.array(M.token_similarity(need)))).filter("tok IS NOT NULL")
    score = F.when(F.col("rejected"), 0.0).otherwise(w.tree_edit * F.col("tree") + w.token_similarity * F.col("tok") + w.structural * F.col("structural") + w.signature * F.col("sig"))
    columns = ("a_ord", "b_ord", "a_file", "b_file", "a_hash", "b_hash", "tree", "tok", "structural", "sig", "similarity")
    scored = pairs.withColumn("similarity", score).filter(F.col("similarity") >= threshold).select(*columns)

    # equal units score 1 whatever their classes; they meet by their hashes
    light = own.drop("token_str", "tok_len")
    names = ("ord", "file", "hash", "norm_hash", "cls")
    a, b = (light.select(*side(light, p, names)) for p in (M.A, M.B))
    alike = a.join(b, F.expr("a_norm_hash = b_norm_hash AND a_ord < b_ord")).unionByName(a.join(b, F.expr("a_hash = b_hash AND a_ord < b_ord AND NOT coalesce(a_norm_hash = b_norm_hash, false)")))
    alike = alike.withColumn("ca", F.least("a_cls", "b_cls")).withColumn("cb", F.greatest("a_cls", "b_cls")).join(met, ["ca", "cb"])
    alike = alike.withColumn("tok", F.lit(1.0)).withColumn("similarity", F.when(F.col("rejected"), 0.0).otherwise(1.0)).filter(F.col("similarity") >= threshold).select(*columns)

    pairs = scored.unionByName(alike)
    if cross_file:
        pairs = pairs.filter(F.col("a_file") != F.col("b_file"))
    swap = F.col("a_ord") > F.col("b_ord")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(
        pick("a_ord", "b_ord").alias("ord1"), pick("b_ord", "a_ord").alias("ord2"), pick("a_file", "b_file").alias("file1"), pick("b_file", "a_file").alias("file2"),
        pick("a_hash", "b_hash").alias("hash1"), pick("b_hash", "a_hash").alias("hash2"), "tree", "tok", "structural", "sig", "similarity", M.category(F.col("similarity")).alias("category"),
    )


def component_estimates(pairs: DataFrame, options: Options | None = None) -> DataFrame:
    """The pairs with ``*_est``: the score times each weight, which is not what was measured (that is in tree, tok, structural, sig)."""
    w = (options or Options()).weights
    of = {"tree_est": w.tree_edit, "tok_est": w.token_similarity, "structural_est": w.structural, "sig_est": w.signature}
    return pairs.withColumns({k: F.col("similarity") * x for k, x in of.items()})
