"""Operator 2: secret spans and multipart credential linking, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import cut, named


def either_case(word: str) -> str:
    """ASCII letters as [Xx] classes, so that every regex engine folds the same letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def keyed(words: list[str], value: str) -> str:
    return f"""({"|".join(either_case(w) for w in words)})["']?\\x20*[:=]\\x20*["']?({value})"""


#: Base kinds, in the order that breaks ties of the start: pattern, least length, group that has it. Runs take all the
#: characters they can, so a least length inside the last two patterns drops the same matches as a test afterwards.
BASE = {
    "assign": (keyed(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), 12, 2),
    "access": ("AKIA[A-Z0-9]{14,}", 18, 0),
    "hex": ("[0-9a-f]{16,}", 16, 0),
}
#: Kinds that alone prove nothing: weak identifiers, weak secrets and endpoints.
WEAK = {
    "weak_id": keyed(["username", "user", "login", "client_?id", "access_?key_?id", "account"], "[A-Za-z0-9@+/_.-]+"),
    "weak_secret": keyed(["secret_?key", "secret_?access_?key", "private_?key", "passphrase", "pass", "pwd"], "[A-Za-z0-9+/_.=-]+"),
    "endpoint": "(https?|ftp|s3|amqp|redis|mysql|mongodb|postgres|postgresql|jdbc:[a-z]+)://[A-Za-z0-9.:-]+",
}
KINDS = [*BASE, *WEAK]
#: What stands in for each part of a credential.
PARTS = {"id": ["access", "weak_id"], "secret": ["assign", "hex", "weak_secret"], "endpoint": ["endpoint"]}
#: Code points between two spans of one scope, at most.
SCOPE = 200
#: Matches of a text that are walked in one go.
PIECE = 256

SPAN = "struct<start:int,kind:int,end:int>"


def found(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches, those too short dropped.

    split() and regexp_extract_all() cut at the same matches, so starts are running sums of both lengths. The matches
    are walked PIECE at a time, each piece from 0 and then moved to where it begins: appending to one array would copy
    it at every match of a long text.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    k = F.lit(KINDS.index(kind))
    pairs = F.slice(F.arrays_zip(F.split(text, pattern).alias("gap"), matches.alias("hit")), 1, F.greatest(F.size(matches), F.lit(1)))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        kept = F.length(F.regexp_extract(p["hit"], pattern, group)) >= least
        span = F.struct(start.alias("start"), k.alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    firsts = F.sequence(F.lit(1), F.size(matches), F.lit(PIECE))
    pieces = F.transform(firsts, lambda i: F.aggregate(F.slice(pairs, i, PIECE), zero, step))
    moved = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("all")),
        lambda acc, x: F.struct(
            (acc["at"] + x["at"]).alias("at"),
            F.concat(acc["all"], F.array(F.transform(x["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end"))))).alias("all"),
        ),
    )
    return F.when(F.size(matches) > 0, F.flatten(moved["all"])).otherwise(none)


def rendered(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kinds: list[str]) -> Column:
    numbers = [KINDS.index(k) for k in kinds]
    return F.filter(spans, lambda s: s["kind"].isin(numbers))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of (scope_key, span) rows: the weak spans whose complements lie within ``scope`` of them.

    Rows meet on (scope_key, bucket): buckets are ``scope`` wide, a weak span stands in every bucket that it touches
    and a part in every bucket that its reach touches. Semi joins make no pairs; a span is reported once.
    Weak identifiers need a secret, weak secrets an identifier, endpoints both.
    """

    def of(role: str) -> DataFrame:
        rows = parts.where(F.col("span.kind").isin([KINDS.index(k) for k in PARTS[role]]))
        reach = F.sequence(F.floor((F.col("span.start") - scope) / scope), F.floor((F.col("span.end") + scope) / scope))
        return rows.select(F.col("scope_key").alias("r_key"), F.col("span").alias("r_span"), F.explode(reach).alias("r_bucket")).distinct()

    def near(left: DataFrame, role: str) -> DataFrame:
        right = of(role)
        gap = F.greatest(F.col("r_span.start") - F.col("span.end"), F.col("span.start") - F.col("r_span.end"))
        on = (F.col("scope_key") == F.col("r_key")) & (F.col("bucket") == F.col("r_bucket")) & (gap <= scope)
        touched = F.sequence(F.floor(F.col("span.start") / scope), F.floor(F.col("span.end") / scope))
        at = left.withColumn("bucket", F.explode(touched))
        return at.join(right, on, "left_semi").select("scope_key", "span").distinct()

    weak = {k: parts.where(F.col("span.kind") == KINDS.index(k)) for k in WEAK}
    return near(weak["weak_id"], "secret").unionByName(near(weak["weak_secret"], "id")).unionByName(near(near(weak["endpoint"], "id"), "secret"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: id, base_spans and linked_spans (arrays of start, kind number, end in code points).

    A null text counts as empty and has no spans. A scope is one text; equal texts share their links, so a text
    copied a million times is joined once. Rows that share an id keep a row each; an empty table gives no rows. Other
    columns are not read; a result column that the id has the name of gets ``_result`` behind it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed_text = text.rlike("[:=]")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    base = {k: found(text, p, k, least, group) for k, (p, least, group) in BASE.items()}
    base["assign"] = F.when(keyed_text, base["assign"]).otherwise(none)
    weak = {k: F.when(keyed_text, found(text, p, k)).otherwise(none) for k, p in WEAK.items()}
    slim = docs.select(F.col(id_col).alias("pw_id"), F.concat(*base.values()).alias("base_spans"), F.concat(*weak.values()).alias("weak_spans"), F.when(F.size(F.concat(*weak.values())) > 0, F.sha2(text, 256)).alias("scope_key"))
    slim = cut(slim, "secret-spans")
    texts = slim.where(F.col("scope_key").isNotNull()).groupBy("scope_key").agg(F.first(F.concat("base_spans", "weak_spans")).alias("all_spans"))
    parts = texts.select("scope_key", F.explode("all_spans").alias("span"))
    links = linked(parts, scope).groupBy("scope_key").agg(F.collect_list("span").alias("linked_spans"))
    plain = slim.where(F.col("scope_key").isNull()).select("pw_id", "base_spans", none.alias("linked_spans"))
    scoped = slim.where(F.col("scope_key").isNotNull()).join(links, "scope_key", "left")
    every = plain.unionByName(scoped.select("pw_id", "base_spans", F.coalesce("linked_spans", none).alias("linked_spans")))
    return every.toDF(id_col, *named(id_col, ["base_spans", "linked_spans"]))


def secret_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base, linked_ = named(id_col, ["base_spans", "linked_spans"])
    counts = [F.size(of_kind(F.col(base), [k])).cast("long") for k in BASE]
    columns = [*counts, F.sha2(rendered(F.col(base)), 256), rendered(F.concat(base, linked_))]
    names = named(id_col, [*(f"n_{k}" for k in BASE), "base_sha256", "spans"])
    return scanned.select(id_col, *(c.alias(n) for c, n in zip(columns, names, strict=True)))


def _sql_found(kind: str, pattern: str, least: int, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT scope_key, string_split_regex(txt, '{quoted}') AS gap, regexp_extract_all(txt, '{quoted}', 0) AS hit FROM texts WHERE regexp_matches(txt, '{quoted}')),
{kind}_i AS (SELECT scope_key, unnest(range(1, len(hit) + 1)) AS i, gap, hit FROM {kind}_m),
{kind}_r AS (SELECT scope_key, {KINDS.index(kind)} AS kind, hit[i] AS h,
  sum(length(gap[i]) + length(hit[i])) OVER (PARTITION BY scope_key ORDER BY i) AS fin FROM {kind}_i),
{kind}_s AS (SELECT scope_key, kind, fin - length(h) AS start, fin AS fin FROM {kind}_r WHERE length(regexp_extract(h, '{quoted}', {group})) >= {least})"""


def oracle() -> str:
    """DuckDB SQL for secret_digest(secret_scan(documents))."""
    ids, secrets = ([KINDS.index(k) for k in PARTS[r]] for r in ("id", "secret"))
    every = [(k, *v) for k, v in BASE.items()] + [(k, p, 0, 0) for k, p in WEAK.items()]
    near = f"o.scope_key = s.scope_key AND greatest(o.start - s.fin, s.start - o.fin) <= {SCOPE}"

    def beside(kinds: list[int]) -> str:
        return f"EXISTS (SELECT 1 FROM spans o WHERE {near} AND o.kind IN ({', '.join(map(str, kinds))}))"

    numbers = {k: KINDS.index(k) for k in KINDS}
    names = "CASE kind " + " ".join(f"WHEN {n} THEN '{k}'" for k, n in numbers.items()) + " END"
    joined = f"string_agg({names} || ':' || start::BIGINT || ':' || fin::BIGINT, ',' ORDER BY start, kind, fin)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS txt, sha256(coalesce(text, '')) AS scope_key FROM documents),
texts AS (SELECT scope_key, any_value(txt) AS txt FROM docs GROUP BY scope_key),{",".join(_sql_found(*x) for x in every)},
spans AS ({" UNION ALL ".join(f"SELECT * FROM {k}_s" for k in KINDS)}),
kept AS (SELECT *, kind < {len(BASE)} AS base FROM spans s WHERE kind < {len(BASE)}
  OR (kind = {numbers["weak_id"]} AND {beside(secrets)}) OR (kind = {numbers["weak_secret"]} AND {beside(ids)})
  OR (kind = {numbers["endpoint"]} AND {beside(ids)} AND {beside(secrets)})),
digest AS (SELECT scope_key, {", ".join(f"count(*) FILTER (kind = {numbers[k]}) AS n_{k}" for k in BASE)},
  sha256(coalesce({joined.replace(")", ")", 1)} FILTER (base), '')) AS base_sha256, {joined} AS spans FROM kept GROUP BY scope_key)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN digest USING (scope_key)"""
