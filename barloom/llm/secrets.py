"""Secrets in texts, judged by how many owners share them. DataFrame functions only.

Candidates of four kinds are cut out of every whole text: assign (a telling name with a value), access (key ids), hex
(long hexadecimal runs) and token (long runs of mixed letters and digits that no other kind covers). Each carries a
128-bit hash of its value. Over the whole corpus the hashes are counted by distinct repository and owner: a value of
WIDE owners or more is a widely copied example, one of fewer that looks live (enough different characters, letters and
digits, no placeholder word) is a credential of its owner. Spans of the first three kinds are always returned and only
marked; a token becomes a span only if it is live, so published hashes and sample keys add nothing.

Places are code points, the end exclusive. They come from the lengths of the texts between matches, summed in order by
a window over a document's matches, so a text with many matches costs no more than its matches. Null and empty texts have
no spans, and a row without spans still gives a row. Rows that repeat an id are scanned each on its own; equal rows give
equal results. A null owner is one owner, a null repository one repository. An empty table gives an empty result; other
columns are ignored whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Kinds in their order, their patterns and the least length of the value.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 12), ("access", r"AKIA[A-Z0-9]{14,}", 18), ("hex", r"[0-9a-f]{16,}", 16), ("token", r"[A-Za-z0-9+/_=-]{20,}", 20))
TOKEN = 3
#: Words and runs of placeholders.
PLACEHOLDER = r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Xx]{4}|0{6}|1234567|abcdef"
#: Owners from which on a value counts as widely copied, different characters that a live one has, and parts of a hot value.
WIDE, DISTINCT, SALTS = 3, 8, 16


def _live(value: Column) -> Column:
    different = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), 0)))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= DISTINCT) & ~value.rlike(PLACEHOLDER)


def _matches(text: Column, kind: int) -> Column:
    """An array of kind, gap (characters since the match before), size, value; short assignments are among them, as
    they end where the next match begins."""
    _, pattern, _ = KINDS[kind]
    each = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1),
        lambda m, gap: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("size"), (F.regexp_extract(m, pattern, 2) if kind == 0 else m).alias("value")))
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,value:string>>")
    return F.when(text.rlike(pattern), F.filter(each, lambda x: x["size"].isNotNull())).otherwise(none)


def candidates(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """row (a number of the input row), id, owner, repo, kind, start, end, h1, h2, live for each candidate; a row of the
    input without any has one row with a null kind. Tokens that meet a span of another kind are left out."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), text.alias("text"))
    rows = rows.select("row", "id", "owner", "repo", F.posexplode_outer(F.concat(*[_matches(F.col("text"), k) for k in range(len(KINDS))])).alias("pos", "m"))
    fit = F.length("m.value") >= F.element_at(F.array(*[F.lit(k[2]) for k in KINDS]), F.col("m.kind") + 1)
    rows = rows.select("row", "id", "owner", "repo", "pos", "m.kind", "m.gap", "m.size", F.xxhash64("m.value").alias("h1"), F.xxhash64(F.lit("second"), "m.value").alias("h2"), (fit & ((F.col("m.kind") != TOKEN) | _live(F.col("m.value")))).alias("fit"), _live(F.col("m.value")).alias("live"))
    rows = common.cut(rows)
    bare = rows.filter("kind is null").select("row", "id", "owner", "repo", "kind", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "h1", "h2", "live")
    upto = Window.partitionBy("row", "kind").orderBy("pos")
    ends = F.sum((F.col("gap") + F.col("size")).cast("long")).over(upto)
    found = rows.filter("kind is not null").repartition("row").withColumn("end", ends).withColumn("start", F.col("end") - F.col("size")).drop("pos", "gap", "size")
    base = F.col("fit") & (F.col("kind") != TOKEN)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    met = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    found = found.withColumn("met", met)
    # a row whose candidates all fall away stays as a row without spans
    keep = F.col("fit") & ((F.col("kind") != TOKEN) | ~F.col("met"))
    nothing = lambda c: F.when(keep, F.col(c)).alias(c)
    return bare.union(found.select("row", "id", "owner", "repo", *[nothing(c) for c in ("kind", "start", "end", "h1", "h2", "live")]))


def ownership(found: DataFrame) -> DataFrame:
    """h1, h2, owners, repos of each candidate value. Every step sums on the map side first, so a value that stands in a
    third of all rows costs each task one row an owner."""
    repos = found.filter("kind is not null").groupBy("h1", "h2", "owner", "repo").agg(F.count(F.lit(1)).alias("places"))
    owners = repos.groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", wide: int = WIDE) -> DataFrame:
    """row, id, kind (a number), start, end, owners, repos, copied (widely) and live (specific to few owners and looking
    so) for each span; a row of df without spans has one row with a null kind."""
    found = common.cut(candidates(df, id_col, text_col, owner_col, repo_col))
    counts = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int")
    spans = found.withColumn("salt", salt).join(counts, ["h1", "h2", "salt"], "left")
    spans = spans.withColumn("copied", F.col("owners") >= wide).withColumn("live", F.col("live") & ~F.col("copied"))
    gone = (F.col("kind") == TOKEN) & ~F.col("live")
    nothing = lambda c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)).alias(c)
    return spans.select("row", "id", *[nothing(c) for c in ("kind", "start", "end", "owners", "repos", "copied", "live")])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", wide: int = WIDE) -> DataFrame:
    """One row per row of df: the id, n_assign, n_access, n_hex, base_sha256, spans, n_token, n_copied, n_live."""
    spans = secret_spans(df, id_col, text_col, owner_col, repo_col, wide)
    number = lambda c: F.count(F.when(c, 1))
    kind = F.col("kind")
    listed = F.array_sort(F.collect_list(F.when(kind.isNotNull(), F.struct("start", "kind", "end"))))
    out = spans.groupBy("row", "id").agg(
        *[number(kind == k).alias(f"n_{KINDS[k][0]}") for k in range(len(KINDS))], number(F.col("copied") & kind.isNotNull()).alias("n_copied"), number(F.col("live") & kind.isNotNull()).alias("n_live"), listed.alias("listed"))
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), x["kind"] + 1), x["start"], x["end"])
    joined = lambda a: F.array_join(F.transform(a, name), ",")
    base = F.filter("listed", lambda x: x["kind"] != TOKEN)
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("listed")).alias("spans"), "n_token", "n_copied", "n_live")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the owners, documents the repositories."""
    return scan_secrets(common.table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LIVE = f"(regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND list_unique(string_split(value, '')) >= {DISTINCT} AND NOT regexp_matches(value, {_quoted(PLACEHOLDER)}))"
_FOUND = " UNION ALL ".join(
    f"SELECT row, doc_id, source, {k} AS kind, {least} AS least, regexp_extract_all(t, {_quoted(pattern)}) AS m, regexp_split_to_array(t, {_quoted(pattern)}) AS g, {'regexp_extract_all(t, ' + _quoted(pattern) + ', 2)' if k == 0 else 'm'} AS v FROM d"
    for k, (_, pattern, least) in enumerate(KINDS))
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
e AS (SELECT *, unnest(range(len(m))) AS i FROM f),
p AS (SELECT row, doc_id, source, kind, least, v[i + 1] AS value, list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS start, length(m[i + 1]) AS size FROM e),
c AS (SELECT row, doc_id, source, kind, start::BIGINT AS start, (start + size)::BIGINT AS stop, value, {_LIVE} AS live FROM p WHERE length(value) >= least AND (kind <> {TOKEN} OR {_LIVE})),
k AS (SELECT * FROM c WHERE kind <> {TOKEN} OR NOT EXISTS (SELECT 1 FROM c b WHERE b.row = c.row AND b.kind <> {TOKEN} AND b.start < c.stop AND b.stop > c.start)),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners FROM k GROUP BY value),
s AS (SELECT k.*, owners >= {WIDE} AS copied, live AND owners < {WIDE} AS alive, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'token' END || ':' || start || ':' || stop AS name FROM k JOIN o USING (value)),
a AS (SELECT * FROM s WHERE kind <> {TOKEN} OR alive)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 sha256(coalesce(string_agg(name, ',' ORDER BY start, kind) FILTER (kind <> {TOKEN}), '')) AS base_sha256, coalesce(string_agg(name, ',' ORDER BY start, kind) FILTER (name IS NOT NULL), '') AS spans,
 count(*) FILTER (kind = {TOKEN}) AS n_token, count(*) FILTER (copied) AS n_copied, count(*) FILTER (alive) AS n_live
FROM d LEFT JOIN a ON d.row = a.row GROUP BY d.row, d.doc_id"""
