"""Near duplicates of texts by MinHash signatures and of vectors by hyperplanes; verification, merging and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import duplicates as D, graph as G
from siltstone.plans.statements import signatures
from siltstone.registry import ORACLE_SQL, query

#: Positions of a signature, and how many of them must be alike (0.85).
VALUES, EQUAL = 128, 109
_CLOSED = "{n} AS (SELECT a AS node, b AS other FROM {p} UNION SELECT b, a FROM {p} UNION SELECT a, a FROM {p} UNION SELECT b, b FROM {p}), {n}r AS (SELECT node, other AS root FROM {n} UNION SELECT {n}.node, r.root FROM {n}r r JOIN {n} ON {n}.other = r.node), {n}c AS (SELECT node, min(root) AS root FROM {n}r GROUP BY node)"
_ALIKE = " + ".join(f"CASE WHEN x.h{i} = y.h{i} THEN 1 ELSE 0 END" for i in range(VALUES))
# signatures once, pairs of different signatures, and their classes
GROUPS = f"""WITH RECURSIVE sig AS MATERIALIZED ({ORACLE_SQL['d2_minhash_signature']}), p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM sig x JOIN sig y ON x.doc_id < y.doc_id WHERE {_ALIKE} >= {EQUAL}),
{_CLOSED.format(n='e', p='p')}, g AS (SELECT doc_id, coalesce(root, doc_id) AS leader FROM sig LEFT JOIN ec ON node = doc_id)"""


def _groups(t):
    return D.signature_groups(signatures(t("documents")), "doc_id", "sig", VALUES, EQUAL)


@query("d3_minhash_groups", f"{GROUPS} SELECT doc_id, leader FROM g")
def _(t):
    return _groups(t)


WORD_COUNTS = r"c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[ \n\t\r]+'), lambda x: x <> '')) AS w FROM documents) z GROUP BY doc_id, w), z AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id)"
COSINES = f"""{GROUPS}, {WORD_COUNTS}, v AS (SELECT g.doc_id, g.leader, round(sum(x.n * y.n) / (max(p1.norm) * max(p2.norm)), 6) AS cosine
FROM g JOIN c x ON x.doc_id = g.doc_id JOIN c y ON y.doc_id = g.leader AND y.w = x.w JOIN z p1 ON p1.doc_id = g.doc_id JOIN z p2 ON p2.doc_id = g.leader WHERE g.doc_id <> g.leader GROUP BY g.doc_id, g.leader)"""


def _cosines(t):
    """doc_id, leader, cosine of the word counts of each member and its leader; words are read for members and leaders only."""
    g = G._cut(_groups(t).where("doc_id <> leader"))
    words = F.explode(F.filter(F.split(F.lower("text"), r"[ \n\t\r]+"), lambda x: x != ""))
    asked = g.select("doc_id").union(g.select("leader")).distinct()
    c = t("documents").join(asked, "doc_id", "left_semi").select("doc_id", words.alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    c = G._cut(c)
    norm = c.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = g.join(c, "doc_id").join(c.select(F.col("doc_id").alias("leader"), "w", F.col("n").alias("m")), ["leader", "w"])
    dots = x.groupBy("doc_id", "leader").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    both = dots.join(norm, "doc_id").join(norm.select(F.col("doc_id").alias("leader"), F.col("norm").alias("other")), "leader")
    return both.select("doc_id", "leader", F.round(F.col("dot") / (F.col("norm") * F.col("other")), 6).alias("cosine"))


@query("j14_cosine_candidates", f"{COSINES} SELECT doc_id, leader, cosine FROM v WHERE cosine >= 0.9")
def _(t):
    return _cosines(t).where("cosine >= 0.9")


@query("d4_two_stage_dedup", f"{COSINES}, k AS (SELECT d.doc_id, coalesce(v.leader, d.doc_id) AS leader, n_chars, source FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id AND cosine >= 0.9) SELECT leader, count(*) AS n, max(n_chars) AS longest, count(DISTINCT source) AS sources FROM k GROUP BY leader")
def _(t):
    kept = _cosines(t).where("cosine >= 0.9").select("doc_id", "leader")
    d = t("documents").select("doc_id", "n_chars", "source").join(kept, "doc_id", "left").withColumn("leader", F.coalesce("leader", "doc_id"))
    return d.groupBy("leader").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.countDistinct("source").alias("sources"))


_META = "0.5 * CASE WHEN a.source = b.source THEN 1 ELSE 0 END + 0.5 * CASE WHEN a.lang = b.lang THEN 1 ELSE 0 END"


@query("d6_content_and_metadata", f"{COSINES} SELECT v.doc_id, leader, round(0.7 * cosine + 0.3 * ({_META}), 5) AS score, 0.7 * cosine + 0.3 * ({_META}) >= 0.85 AS same FROM v JOIN documents a ON a.doc_id = v.doc_id JOIN documents b ON b.doc_id = leader".replace("0.5", "0.5e0").replace("0.7", "0.7e0").replace("0.3 ", "0.3e0 "))
def _(t):
    d = t("documents").select("doc_id", "source", "lang")
    both = _cosines(t).join(d, "doc_id").join(d.select(F.col("doc_id").alias("leader"), F.col("source").alias("s"), F.col("lang").alias("l")), "leader")
    same = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))
    score = 0.7 * F.col("cosine") + 0.3 * (0.5 * same("source", "s") + 0.5 * same("lang", "l"))
    return both.select("doc_id", "leader", F.round(score, 5).alias("score"), (score >= 0.85).alias("same"))


#: The cosine that links two vectors.
LEAST = 0.95
_TURNED = "list_transform(range(1, len(embedding) + 1), lambda i: 0.9e0 * embedding[i] + 0.1e0 * embedding[len(embedding) + 1 - i])"


@query(
    "j15_cosine_self_join",
    f"WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings UNION ALL SELECT vec_id + 1000000000, {_TURNED} FROM embeddings WHERE label % 2 = 1), p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {LEAST}), {_CLOSED.format(n='e', p='p')} SELECT vec_id, coalesce(root, vec_id) AS leader FROM v LEFT JOIN ec ON node = vec_id",
)
def _(t):
    """Classes of vectors and of turned copies of every second label's; all are compared, block by block."""
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    turned = t("embeddings").where("label % 2 = 1").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.zip_with("embedding", F.reverse("embedding"), lambda x, y: 0.9 * x + 0.1 * y).alias("e"))
    return D.vector_groups(e.union(turned), "vec_id", "e", LEAST)
