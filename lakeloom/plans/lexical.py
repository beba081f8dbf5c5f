"""Queries of cleaning, segmentation and lexical functions.

The documents hardly hold what the rules look for, so a block of noise is put before each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import paths as P
from lakeloom.functions import text as T
from lakeloom.functions import vectors as V
from lakeloom.operators import chunking
from lakeloom.plans.book import book, table
from lakeloom.session import spread
from lakeloom.sources import nodes as N

BOOK, query = book()

NOISE = "Page 3 of 9\nCONFIDENTIAL\n 3/15 \nTotal......12 ----- x\t\ty\r\n- 12 -\n17\nCopyright 2024 Acme\nlast updated today\n\n\n\n\nBody"
NOISE_SQL = "replace(replace(replace('" + NOISE.replace("\n", "~n").replace("\t", "~t").replace("\r", "~r") + "', '~n', chr(10)), '~t', chr(9)), '~r', chr(13)) || chr(10) || text"


def noisy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return spread(table(spark, sf_dir, "documents")), F.concat(F.lit(NOISE + "\n"), "text")


def _rule(pattern: str, to: str) -> str:
    return f"SELECT doc_id, regexp_replace({NOISE_SQL}, '{pattern}', {to}, 'g') AS cleaned FROM documents"


@query(_rule(T.BLANKS, "' '"))
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = noisy(spark, sf_dir)
    return docs.select("doc_id", T.squeeze_blanks(text).alias("cleaned"))


@query(_rule(T.LEADERS, "' '"))
def clean_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = noisy(spark, sf_dir)
    return docs.select("doc_id", T.drop_leaders(text).alias("cleaned"))


@query(_rule(T.PAGE_NUMBERS, "''"))
def clean_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = noisy(spark, sf_dir)
    return docs.select("doc_id", T.drop_page_numbers(text).alias("cleaned"))


@query(_rule(T.HEADERS, "''"))
def clean_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = noisy(spark, sf_dir)
    return docs.select("doc_id", T.drop_headers(text).alias("cleaned"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace({NOISE_SQL}, '\\n{{4,}}', chr(10) || chr(10), 'g'), '\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g') AS cleaned FROM documents")
def clean_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = noisy(spark, sf_dir)
    return docs.select("doc_id", T.collapse_blank_lines(text).alias("cleaned"))


@query("""WITH t AS (SELECT doc_id, 'Footer line here' || chr(10) || replace(text, '. ', chr(10) || 'Footer line here' || chr(10)) AS text FROM documents),
l AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n+\\z', ''), chr(10)) AS lines FROM t),
c AS (SELECT *, list_transform(lines, lambda x: trim(x)) AS st FROM l),
o AS (SELECT *, list_filter(list_distinct(st), lambda u: length(u) BETWEEN 4 AND 99 AND len(list_filter(st, lambda x: x = u)) >= greatest(3, len(lines) // 7)) AS often FROM c)
SELECT doc_id, CASE WHEN len(lines) < 10 OR len(often) = 0 THEN text ELSE coalesce(array_to_string(list_transform(list_filter(lines, lambda x: NOT list_contains(often, trim(x))), lambda x: x || chr(10)), ''), '') END AS cleaned FROM o""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Footer line here\n"), F.replace("text", F.lit(". "), F.lit("\nFooter line here\n")))
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_boilerplate(text).alias("cleaned"))


def clean_sql(text: str, source: str, aggressive: bool) -> str:
    """CTEs that clean `text` of `source` (doc_id, ...) rule by rule; the last one is `cleaned`.

    Runs of more than ten equal signs, which need a back reference, are found as islands of equal characters.
    """
    lines = "CASE WHEN len(lines) < 10 OR len(often) = 0 THEN text ELSE coalesce(array_to_string(list_transform(list_filter(lines, lambda x: NOT list_contains(often, trim(x))), lambda x: x || chr(10)), ''), '') END"
    return f"""n0 AS (SELECT doc_id, {text} AS raw, regexp_replace({text}, '[\\x00\\f\\x{{FEFF}}\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2028}}\\x{{2029}}]', '', 'g') AS text FROM {source}),
ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM n0),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch),
run AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c, g) AS n FROM isl),
n1 AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS text FROM run WHERE n < 11 OR c IN (chr(10), chr(13)) GROUP BY 1),
n2 AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), '{T.LEADERS}', ' ', 'g') AS text FROM n1),
n3 AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{T.PAGE_NUMBERS}', '', 'g'), '{T.HEADERS}', '', 'g') AS text FROM n2),
n4 AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n+\\z', ''), chr(10)) AS lines FROM n3),
n5 AS (SELECT *, list_transform(lines, lambda x: trim(x)) AS st FROM n4),
n6 AS (SELECT *, list_filter(list_distinct(st), lambda u: length(u) BETWEEN 4 AND 99 AND len(list_filter(st, lambda x: x = u)) >= greatest(3, len(lines) // 7)) AS often FROM n5),
n7 AS (SELECT doc_id, {lines if aggressive else "text"} AS text FROM {"n6" if aggressive else "n3"}),
cleaned AS (SELECT n0.doc_id, CASE WHEN regexp_full_match(raw, '[\\x00-\\x20]*') THEN '' ELSE coalesce(regexp_replace(regexp_replace(n7.text, '\\n{{4,}}', chr(10) || chr(10), 'g'), '\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g'), '') END AS text FROM n0 LEFT JOIN n7 USING (doc_id))
"""


@query("WITH " + clean_sql(NOISE_SQL, "documents", True) + "SELECT doc_id, text AS cleaned FROM cleaned")
def noise_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = noisy(spark, sf_dir)
    return docs.select("doc_id", T.clean(text, aggressive=True).alias("cleaned"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.whitespace_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 1.0 ELSE greatest(1.0, 2.2::DOUBLE - length(regexp_replace(text, '[\\p{L}\\p{Nd}\\s]', '', 'g'))::DOUBLE / length(text) * 5.0) END, 9) AS cpt FROM documents")
def chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.chars_per_token(F.col("text")), 9).alias("cpt"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '\\s+'), 1) AS i FROM benchmark),
b AS (SELECT item_id, i, regexp_replace(regexp_replace(w, '[\\\\''%_]', '', 'g'), '^[^\\p{{L}}\\p{{Nd}}]+|[^\\p{{L}}\\p{{Nd}}]+$', '', 'g') AS t FROM w),
d AS (SELECT item_id, t, min(i) AS i FROM b WHERE length(t) >= 3 AND t NOT IN ({_STOP}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM d QUALIFY n <= 12)
SELECT item_id, string_agg(t, ' ' ORDER BY i) AS terms FROM r GROUP BY 1""")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select("item_id", T.keyword_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    return found.select("item_id", F.array_join("terms", " ").alias("terms"))


@query("SELECT conv_id, turn, trim(regexp_replace('  - ' || text, '^\\s*(?:[-*•]|\\d+[.)])\\s*', '')) AS bare FROM conversations")
def list_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_list_mark(F.concat(F.lit("  - "), "text")).alias("bare"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) > 0 THEN substr(text, 1, 64000) END AS mirrored FROM documents")
def extracted_text_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.mirror_text(F.col("text")).alias("mirrored"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE substr(text, 11) END AS delta FROM conversations")
def stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = F.when(F.col("turn") % 3 == 0, F.lit("another answer")).otherwise(F.substring("text", 1, 10))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.stream_delta(F.col("text"), so_far).alias("delta"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"


def _pieces(marked: str) -> str:
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"


# a sentence ends behind a line's end, behind a semicolon, and behind a full stop before a capital
SENTENCES = "regexp_replace(regexp_replace(regexp_replace({t}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), ';\\s+', ';' || chr(1), 'g'), '\\n\\s*', chr(10) || chr(1), 'g')"


@query(f"WITH s AS (SELECT doc_id, {_pieces(SENTENCES.format(t='text'))} AS p FROM documents) SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, unnest(p) AS sentence FROM s")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


SECTIONS = "regexp_replace(text, '" + T.HEADINGS + "', chr(1) || '\\0', 'g')"


@query(f"WITH d AS (SELECT doc_id, replace('Intro~# One~body~CHAPTER 2~', '~', chr(10)) || text AS text FROM documents), s AS (SELECT doc_id, {_pieces(SECTIONS)} AS p FROM d) SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, unnest(p) AS section FROM s")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sections(F.concat(F.lit("Intro\n# One\nbody\nCHAPTER 2\n"), "text"))).alias("pos", "section"))


def _places(pieces: str, text: str) -> str:
    """Structs of pieces (their text stripped) and their places, of pieces that lie end to end in a text."""
    return f"list_transform(range(1, len({pieces}) + 1), lambda i: {{'s': {_strip(pieces + '[i]')}, 'a': list_sum(list_transform({pieces}[1:i], lambda x: length(x))) - length({pieces}[i]), 'z': list_sum(list_transform({pieces}[1:i], lambda x: length(x)))}})"


def chunks_sql(most: int = 512, least: int = 200, overlap: int = 150) -> str:
    """CTEs from `cleaned` (doc_id, text) to `chunk` (doc_id, idx, part, a, z).

    Sections that are too long are cut into paragraphs, else sentences, if those fit, else into windows at
    a fixed stride; a fold joins the pieces. Blank pieces are dropped; a sentence's place is its first
    occurrence from the end of the one before.
    """
    stride = max(most // 2, most - overlap)
    return f"""sec AS (SELECT doc_id, text, string_split({SECTIONS}, chr(1)) AS raw FROM cleaned WHERE regexp_matches(text, '\\S')),
piece AS (SELECT doc_id, unnest({_places('raw', 'text')}) AS p FROM sec),
sect AS (SELECT doc_id, p.s AS s, CAST(p.a AS BIGINT) AS a, CAST(p.z AS BIGINT) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY p.a, p.z) AS k FROM piece WHERE p.s <> ''),
long AS (SELECT doc_id, k, s, length(s) AS n, string_split(regexp_replace(s, '\\n\\s*\\n', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS pr FROM sect WHERE length(s) > {most}),
par AS (SELECT doc_id, k, unnest(list_transform(range(1, len(pr) + 1), lambda i: {{'raw': pr[i], 'i': i, 'z': list_sum(list_transform(pr[1:i], lambda x: length(replace(x, chr(2), ''))))}})) AS p FROM long),
pars AS (SELECT doc_id, k, {_strip("CASE WHEN p.i = 1 THEN p.raw ELSE split_part(p.raw, chr(2), 2) END")} AS s, CAST(p.z AS BIGINT) - length(CASE WHEN p.i = 1 THEN p.raw ELSE split_part(p.raw, chr(2), 2) END) AS a, CAST(p.z AS BIGINT) AS z, p.i AS i FROM par),
goodp AS (SELECT doc_id, k FROM pars WHERE s <> '' GROUP BY 1, 2 HAVING count(*) > 1 AND max(length(s)) <= {most}),
sen AS (SELECT doc_id, k, s AS whole, string_split({SENTENCES.format(t='s')}, chr(1)) AS sp FROM long ANTI JOIN goodp USING (doc_id, k)),
sens AS (SELECT doc_id, k, whole, list_filter(sp, lambda x: {_strip('x')} <> '') AS ss FROM sen),
goods AS (SELECT * FROM sens WHERE len(ss) > 1 AND list_max(list_transform(ss, lambda x: length({_strip('x')}))) <= {most}),
spot AS (SELECT doc_id, k, whole, ss, 0 AS i, 0::BIGINT AS a, 0::BIGINT AS z FROM goods
  UNION ALL SELECT doc_id, k, whole, ss, i + 1, z + strpos(substr(whole, z + 1), ss[i + 1]) - 1, z + strpos(substr(whole, z + 1), ss[i + 1]) - 1 + length(ss[i + 1]) FROM spot WHERE i < len(ss)),
win AS (SELECT doc_id, k, s, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - {most}) / {stride}.0) AS BIGINT)))) * {stride} AS a FROM long ANTI JOIN goodp USING (doc_id, k) ANTI JOIN goods USING (doc_id, k)),
ends AS (SELECT *, a + length(regexp_extract(substr(s, a + 1, {most} + 1), '(?s)^(.*) ', 1)) AS sp FROM win),
wins AS (SELECT doc_id, k, a, CASE WHEN a + {most} < n AND sp > a + {most // 2} THEN sp ELSE least(a + {most}, n) END AS z, s FROM ends),
parts AS (SELECT doc_id, k, 0::BIGINT AS j, s, a, z FROM sect WHERE length(s) <= {most}
  UNION ALL SELECT p.doc_id, p.k, p.i, p.s, p.a, p.z FROM pars p JOIN goodp USING (doc_id, k) WHERE p.s <> ''
  UNION ALL SELECT doc_id, k, i, {_strip('ss[i]')}, a, z FROM spot WHERE i > 0
  UNION ALL SELECT doc_id, k, a, {_strip('substr(s, a + 1, z - a)')}, a, z FROM wins WHERE {_strip('substr(s, a + 1, z - a)')} <> ''),
lists AS (SELECT doc_id, list({{'s': s, 'a': a, 'z': z}} ORDER BY k, j) AS ps FROM parts GROUP BY 1),
fold AS (SELECT doc_id, ps, 0 AS i, '' AS held, -1::BIGINT AS b, 0::BIGINT AS e, NULL::VARCHAR AS part, 0::BIGINT AS pa, 0::BIGINT AS pz FROM lists
  UNION ALL SELECT doc_id, ps, i + 1,
    CASE WHEN i = len(ps) THEN '' WHEN base <> '' THEN base || chr(10) || ps[i + 1].s ELSE ps[i + 1].s END,
    CASE WHEN i = len(ps) THEN -1 WHEN b2 < 0 THEN ps[i + 1].a ELSE b2 END, CASE WHEN i = len(ps) THEN 0 ELSE ps[i + 1].z END,
    CASE WHEN cut THEN {_strip('held')} END, b, e FROM (
      SELECT *, CASE WHEN cut THEN tl ELSE held END AS base, CASE WHEN cut THEN CASE WHEN tl <> '' THEN e - length(tl) ELSE -1 END ELSE b END AS b2 FROM (
        SELECT *, CASE WHEN length(t0) >= 20 THEN t0 ELSE '' END AS tl FROM (
          SELECT *, CASE WHEN length({_strip('held')}) > {overlap} THEN {_strip(f"CASE WHEN strpos(right({_strip('held')}, {overlap}), ' ') BETWEEN 1 AND {overlap} - 1 THEN substr(right({_strip('held')}, {overlap}), strpos(right({_strip('held')}, {overlap}), ' ') + 1) ELSE right({_strip('held')}, {overlap}) END")} ELSE '' END AS t0 FROM (
            SELECT doc_id, ps, i, held, b, e, CASE WHEN i = len(ps) THEN held <> '' ELSE length(held) + length(ps[i + 1].s) + 1 > {most} AND length(held) >= {least} END AS cut FROM fold WHERE i <= len(ps)))))),
chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, part, pa AS a, pz AS z FROM fold WHERE part IS NOT NULL)
"""


CHUNKS = "WITH RECURSIVE " + clean_sql("text", "documents", False) + ", " + chunks_sql()


@query(CHUNKS + """SELECT doc_id, doc_id || '_chunk_' || idx AS chunk_id, CAST(idx AS INT) AS "index", part AS text, CAST(a AS INT) AS start, CAST(z AS INT) AS "end" FROM chunk""")
def chunks_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"))


# from each begin: the end, at the last space, and the next begin
@query(f"""WITH RECURSIVE w AS (SELECT doc_id, text, length(text) AS n, 0 AS pos, -1 AS kept, 0 AS b, 0 AS stop, '' AS part, 0 AS idx FROM documents WHERE regexp_matches(text, '\\S')
UNION ALL SELECT doc_id, text, n, CASE WHEN stop >= n THEN n WHEN stop - 200 > kept2 THEN stop - 200 ELSE stop END, kept2, pos, stop, part, idx + CASE WHEN part <> '' THEN 1 ELSE 0 END FROM (
  SELECT *, CASE WHEN part <> '' THEN pos ELSE kept END AS kept2 FROM (
    SELECT *, {_strip("substr(text, pos + 1, stop - pos)")} AS part FROM (
      SELECT doc_id, text, n, pos, kept, idx, CASE WHEN pos + 1000 < n AND sp > 0 THEN pos + sp ELSE least(pos + 1000, n) END AS stop FROM (
        SELECT doc_id, text, n, pos, kept, idx, length(regexp_extract(substr(text, pos + 1, 1001), '(?s)^(.*) ', 1)) AS sp FROM w WHERE pos < n)))))
SELECT doc_id, CAST(idx - 1 AS INT) AS "index", part AS text, CAST(b AS INT) AS start, CAST(stop AS INT) AS "end" FROM w WHERE part <> ''""")
def chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), 1000, 200)


def _last(sign: str, window: int) -> str:
    """Place of the last such sign from `lim` down to `window` before, or -1."""
    part = f"substr(c, greatest(0, lim - {window}) + 1, lim - greatest(0, lim - {window}) + 1)"
    return f"CASE WHEN contains({part}, {sign}) THEN greatest(0, lim - {window}) + length(regexp_extract({part}, '(?s)^(.*)' || regexp_escape({sign}), 1)) ELSE -1 END"


@query(f"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\x00', '', 'g'), '[ \\t\\x0B\\f\\r]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g') AS s FROM documents),
k AS (SELECT doc_id, substr(s, 1, 3000) AS c FROM s),
l AS (SELECT *, CAST(trunc((CASE WHEN length(c) = 0 THEN 1.0 ELSE greatest(1.0, 2.2::DOUBLE - length(regexp_replace(c, '[\\p{{L}}\\p{{Nd}}\\s]', '', 'g'))::DOUBLE / length(c) * 5.0::DOUBLE) END) * 480) AS INT) AS lim FROM k),
m AS (SELECT *, {_last("'.'", 80)} AS dot, {_last("chr(10)", 80)} AS line, {_last("' '", 40)} AS space FROM l)
SELECT doc_id, CASE WHEN length(c) <= lim THEN c ELSE substr(c, 1, CASE WHEN dot > 0 THEN dot + 1 WHEN line > 0 THEN line WHEN space > 0 THEN space ELSE lim END) END AS truncated FROM m""")
def token_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_to_budget(T.sanitize(F.col("text"))).alias("truncated"))


@query(CHUNKS + "SELECT doc_id || '_chunk_' || idx AS chunk_id, part AS text, 16 AS dims, 1.0::DOUBLE AS length FROM chunk")
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the vectors of their text and its context; the text itself is kept as it is."""
    rows = chunking.chunk_documents(table(spark, sf_dir, "documents"))
    context = F.concat(F.lit("Document: d"), F.col("doc_id").cast("string"), F.lit(" | Path: /"), F.lit("\n\n"), F.col("text"))
    vectors = rows.select("chunk_id", "text", V.embed(context, V.HashingEmbedder(16)).alias("vector"))
    return vectors.select("chunk_id", "text", F.size("vector").alias("dims"), F.round(V.norm(F.col("vector")), 6).alias("length"))


PAGES = "p AS (SELECT page_id, '/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+', '/', 'g'), '^/|/$', '', 'g') AS path FROM pages) "


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.normal_path(F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))


@query("WITH " + PAGES + ", s AS (SELECT page_id, string_split(path, '/') AS a FROM p) SELECT page_id, array_to_string(list_transform(range(len(a) - 2, 0, -1), lambda n: '/' || array_to_string(a[2:n + 1], '/')), ' ') AS ancestors FROM s WHERE len(a) > 2")
def ancestor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_paths(spark, sf_dir).select("page_id", P.ancestor_paths(F.col("path")).alias("a")).where(F.size("a") > 0)
    return found.select("page_id", F.array_join("a", " ").alias("ancestors"))


@query("WITH " + PAGES + "SELECT page_id, path FROM p WHERE regexp_full_match(path, '/.*1.*')")
def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).where(P.matches_glob(F.col("path"), "/*1*"))


def _sql_encoded(value: str, kept: str) -> str:
    out = f"url_encode({value})"
    for sign in kept:
        out = f"replace({out}, '%{ord(sign):02X}', '{sign * 2 if sign == chr(39) else sign}')"
    return out


NAMES = "d AS (SELECT doc_id, 'repo:' || source AS full_id, source, '/' || lang || ' docs/é & co/' || source AS path, trim(substr(regexp_replace(text, '[\\x00-\\x20]+', ' ', 'g'), 1, 16)) AS name FROM documents)"


@query("WITH " + NAMES + f"""SELECT doc_id, full_id, source AS bare_id, CASE WHEN name <> '' THEN 'https://h/' || source || {_sql_encoded("path || '/' || name", "!$&'()*+,;=:@/")} || '?id=' || doc_id || '&n=' || {_sql_encoded("name", "!$&'()*+,;=:@")} END AS link FROM d""")
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and links of documents whose folders and names, the begin of their text, have blanks, accents and other signs."""
    full = P.source_id(F.lit("repo"), F.col("source"))
    name = F.trim(F.substring(F.regexp_replace("text", r"[\x00-\x20]+", " "), 1, 16))
    values = P.link_values(F.col("doc_id").cast("string"), full, F.concat(F.lit("/"), "lang", F.lit(" docs/é & co/"), "source"), name)
    link = P.open_link(F.lit("https://h/{sourceId}{documentPath}?id={nodeId}&n={sourceName}"), values, ("nodeId",))
    return table(spark, sf_dir, "documents").select("doc_id", full.alias("full_id"), F.element_at(P.source_id_variants(full), 2).alias("bare_id"), link.alias("link"))


_HTML = f"regexp_replace(regexp_replace(html, '{N.SKIPPED}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _sign in N.ENTITIES:
    _HTML = f"replace({_HTML}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, trim(regexp_replace({_HTML}, '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", N.text_of(F.col("html").cast("binary"), F.lit("text/html")).alias("text"))
