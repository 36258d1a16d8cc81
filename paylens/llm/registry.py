"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_digests
from .collocations import collocations
from .common import table
from .decontaminate import find_leaks
from .html_text import extract_text
from .jaccard_join import near_duplicates
from .license_scan import PHRASES, TEMPLATES, license_scan
from .quality_model import quality_scores
from .quality_rules import COMMON_WORDS, WORD_LIST, quality_rules
from .substring_dedup import remove_repeats
from .token_files import token_file_digests
from .toxicity import toxicity_scores
from .warc import warc_round_trip
from .whitening import whiten

# The vocabulary that op1 and the pipeline use.
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
# The one of op11.
WORD_VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("n_copies")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("n_spans")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("nearest_language", "character_distance", "word_distance")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_text": op9_html_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_files": op11_token_files,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_phrase_collocations": op13_phrase_collocations,
}

SPLIT = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# Words of license scans: A-Z as lower case, parts between the separators.
LICENSE_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
LICENSE_SQL = f"""
    WITH d AS (SELECT doc_id, {LICENSE_WORDS} AS w FROM documents),
    t AS (SELECT id, label, {LICENSE_WORDS} AS w FROM (VALUES {", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))}) v(id, label, text)),
    x AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS a, unnest(list_concat(w[2:], [''])) AS b, unnest(list_concat(w[3:], ['', ''])) AS c FROM d),
    p AS (SELECT doc_id, i, CASE {" ".join(f"WHEN {' AND '.join(f'{v} = {chr(39)}{word}{chr(39)}' for v, word in zip('abc', phrase.split(), strict=False))} THEN '{label}'" for phrase, label in PHRASES.items())} END AS label FROM x),
    base AS (SELECT doc_id, count(label) AS n_base, min(i) FILTER (WHERE label IS NOT NULL) AS first_word, max(i) FILTER (WHERE label IS NOT NULL) AS last_word, list(DISTINCT label) FILTER (WHERE label IS NOT NULL) AS found FROM p GROUP BY 1),
    g AS (SELECT doc_id, i, a || ' ' || b || ' ' || c AS g FROM x WHERE c <> ''),
    tg AS (SELECT id, label, w AS tw, len(w) - 2 AS grams, unnest(range(len(w) - 2)) AS j, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS g FROM t),
    h AS (SELECT DISTINCT doc_id, id, label, tw, grams, i - j AS diagonal, j FROM g JOIN tg USING (g)),
    v AS (SELECT doc_id, id, label, tw, grams, diagonal, list(j) AS js FROM h GROUP BY ALL),
    m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 3 THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY doc_id, id ORDER BY diagonal)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS band FROM m),
    pr AS (SELECT n.*, r.diagonal AS high FROM n JOIN n r ON n.doc_id = r.doc_id AND n.id = r.id AND n.band = r.band AND r.diagonal BETWEEN n.diagonal AND n.diagonal + len(n.tw) * 4 // 10),
    s AS (SELECT pr.doc_id, pr.label, pr.tw, pr.grams, pr.diagonal AS low, pr.high, len(list_distinct(flatten(list(c.js)))) AS hit
      FROM pr JOIN n c ON c.doc_id = pr.doc_id AND c.id = pr.id AND c.band = pr.band AND c.diagonal BETWEEN pr.diagonal AND pr.high GROUP BY ALL),
    z AS (SELECT doc_id, label, tw, w[greatest(low, 0) + 1:least(high + len(tw), len(w))] AS span FROM s JOIN d USING (doc_id) WHERE hit >= 0.4 * grams),
    -- Edit distance by rows: a row's own dependence is the running least of what comes from the row before.
    e AS (SELECT doc_id, label, tw, list_reduce(list_transform(span, lambda x: {{'w': x, 'r': cast([] AS bigint[])}}), lambda a, x: {{'w': x.w, 'r': list_transform(range(0, len(tw) + 1), lambda j: j + list_min(list_transform(range(0, j + 1),
      lambda k: CASE WHEN k = 0 THEN a.r[1] + 1 ELSE least(a.r[k + 1] + 1, a.r[k] + CASE WHEN tw[k] = x.w THEN 0 ELSE 1 END) END - k)))}}, {{'w': '', 'r': range(0, len(tw) + 1)}}).r[-1] AS edits FROM z),
    o AS (SELECT doc_id, list(DISTINCT label) AS labels, max(1 - edits / len(tw)) AS coverage FROM e WHERE 1 - edits / len(tw) >= 0.6 GROUP BY 1)
    SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(labels, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(coverage, 0.0) END AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN o USING (doc_id)"""


def rest_of(counts: list[str], total: str) -> str:
    """Shares of a total with what is left of it as the last one."""
    left = f"greatest({total} - ({' + '.join(counts)}), 0)"
    return "[" + ", ".join(f"{c} / nullif({' + '.join(counts)} + {left}, 0)" for c in [*counts, left]) + "]"


def distance(p: str, q: str) -> str:
    part = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    terms = part.format(a="z[1]", b="z[2]") + " + " + part.format(a="z[2]", b="z[1]")
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {terms})) / 2, 0))"


def references(rows: str) -> str:
    """Mean shares by language."""
    mean = lambda c, n: "[" + ", ".join(f"avg({c}[{i}])" for i in range(1, n + 1)) + "]"
    return f"SELECT lang, {mean('c', 6)} AS rc, {mean('s', len(WORD_LIST) + 1)} AS rs FROM {rows} WHERE lang IN ({', '.join(repr(x) for x in COMMON_WORDS)}) AND NOT base_failed AND n_words >= 50 GROUP BY 1"


def nearest(rows: str, refs: str) -> str:
    """Rows with the distances to the language of the nearest words."""
    return f"SELECT x.*, min({{'wd': {distance('s', 'rs')}, 'cd': {distance('c', 'rc')}}}) AS best FROM {rows} x, {refs} r GROUP BY ALL"


QUALITY_SQL = rf"""
    WITH d AS (SELECT doc_id, lang, text, {SPLIT.format(text="coalesce(text, '')")} AS w FROM documents),
    l AS (SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]'))) AS line FROM d),
    dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY 1),
    p AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) >= 8),
    pr AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    rw AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM pr) GROUP BY 1),
    b AS (SELECT doc_id, lang, cast(len(w) AS bigint) AS n_words, array_to_string(w, '') AS j, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      {", ".join(f"len(list_filter(w, lambda x: x = '{w}' OR x = '{w.capitalize()}')) AS w{i}" for i, w in enumerate(WORD_LIST))} FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
    e AS (SELECT *, cast(length(j) AS bigint) AS word_chars, cast(length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, length(j) - length(regexp_replace(j, '\p{{Lu}}', '', 'g')) AS n_upper, length(j) - length(regexp_replace(j, '[0-9]', '', 'g')) AS n_digit,
      length(j) - length(regexp_replace(j, '[!"''()+,\-./:;=?@\[\]\^_`{{}}~]', '', 'g')) AS n_punct, octet_length(encode(j)) - length(j) AS n_wide, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
    a AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {rest_of(["n_symbols", "n_upper", "n_digit", "n_punct", "n_wide"], "(word_chars + n_wide)")} AS c, {rest_of([f"w{i}" for i in range(len(WORD_LIST))], "n_words")} AS s FROM e),
    r1 AS ({references("a")}), k AS (SELECT * FROM a WHERE lang IN ({", ".join(repr(x) for x in COMMON_WORDS)}) AND NOT base_failed AND n_words >= 50), n1 AS ({nearest("k", "r1")}),
    r2 AS ({references("(SELECT * FROM n1 WHERE best.cd <= 0.35 AND best.wd <= 0.5)")}), n2 AS ({nearest("a", "r2")})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (n_words < 50 OR (lang IS NOT NULL AND lang NOT IN (SELECT lang FROM r2)) OR (best.cd <= 0.35 AND best.wd <= 0.5 AND NOT (best.cd > 0.185 AND best.wd > 0.21))) AS kept FROM n2"""

# Pieces, their words, runs of 1 to 5 words counted by language, every cut of those with two or more.
PHRASE_SQL = r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    t AS (SELECT lang, cast(sum(len(w)) AS hugeint) AS n FROM w GROUP BY 1),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS words FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
    f AS (SELECT lang, k, words, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, k, words, f AS a, ' ' || array_to_string(words, ' ') || ' ' AS s FROM f WHERE k > 1),
    m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = c.lang AND y.k > c.k AND 100 * y.a >= 100 * c.a AND contains(y.s, c.s))),
    u AS (SELECT m.*, unnest(range(1, k)) AS cut FROM m),
    x AS (SELECT u.lang, u.words, u.a, cut, l.f AS l, r.f AS r, t.n, (1000 * u.a * t.n) // (cast(l.f AS hugeint) * r.f) AS score FROM u JOIN t USING (lang)
      JOIN f l ON l.lang = u.lang AND l.k = cut AND l.words = u.words[1:cut] JOIN f r ON r.lang = u.lang AND r.k = u.k - cut AND r.words = u.words[cut + 1:]),
    b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, cast(n AS bigint) AS n, cast(score AS bigint) AS score
    FROM b QUALIFY rank <= 2000"""

SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
        r AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
          CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> top THEN top END AS refers_to
        FROM p LEFT JOIN r USING (payload_digest)""",
    "op3_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {SPLIT.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = documents.doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)""",
    # Every window that shares a shingle with an item, compared as it stands: the others have similarity 0.
    "op7_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {SPLIT.format(text="lower(coalesce(text, ''))")} AS w FROM documents),
        t AS (SELECT item_id, w, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS size FROM (SELECT item_id, {SPLIT.format(text="lower(coalesce(text, ''))")} AS w FROM benchmark) WHERE len(w) > 0),
        tg AS (SELECT item_id, k, size, unnest(list_transform(range(1, size + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM t),
        m AS (SELECT item_id, k, size, g, count(*) AS n_item FROM tg GROUP BY ALL),
        dg AS (SELECT doc_id, k, len(w) - k + 1 AS n, unnest(range(len(w) - k + 1)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
          FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k),
        h AS (SELECT doc_id, item_id, k, size, n, i, g, n_item FROM dg JOIN m USING (k, g)),
        s AS (SELECT DISTINCT doc_id, item_id, k, size, n, unnest(range(i - size + 1, i + 1)) AS start FROM h),
        c AS (SELECT s.doc_id, s.item_id, s.k, s.size, s.n, start, g, n_item, count(*) AS n_held FROM s JOIN h ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.i >= start AND h.i < start + s.size GROUP BY ALL),
        v AS (SELECT doc_id, item_id, k, size, start, greatest(start, 0) AS first, least(start + size, n) - greatest(start, 0) AS n_window, sum(least(n_held, n_item)) AS common FROM c GROUP BY doc_id, item_id, k, size, start, n),
        q AS (SELECT *, cast(common AS double) / cast(n_window + size - common AS double) AS similarity FROM v)
        SELECT doc_id, item_id, similarity, cast(first AS bigint) AS first_word, cast(first + n_window + k - 2 AS bigint) AS last_word FROM q WHERE similarity >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first, n_window DESC) = 1""",
    "op8_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {SPLIT.format(text="coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
        f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM p JOIN f USING (h) WHERE doc_id > first),
        x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
        k AS (SELECT x.doc_id, count(c.j) AS n_removed, coalesce(string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY x.j), '') AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j GROUP BY 1)
        SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op6_license_scan": LICENSE_SQL,
    "op10_quality_rules": QUALITY_SQL,
    "op13_phrase_collocations": PHRASE_SQL,
}
