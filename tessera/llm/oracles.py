"""DuckDB twins of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from tessera.llm import quality_rules as rules
from tessera.llm.url_filters import Rule

_WHITE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _list(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def quality_rules(source: str = "documents") -> str:
    """Counts by regular expressions, windows by unnesting, divergence bin by bin."""
    bins = {
        "lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "white": r"[^\x20\x09-\x0D]",
        "symbol": "[^#*$%&|<>]", "point": "[^.,;:!?''\"()-]",
    }
    ascii_rest = "".join(
        chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in rules.SYMBOLS + rules.PUNCTUATION
    )
    escaped = "".join("\\" + c if c in "[]\\^-" else c for c in ascii_rest)
    bins["other"] = rf"[^{escaped}\x00-\x08\x0E-\x1F\x7F]"
    counts = ",\n".join(f"len(regexp_replace(t, '{p}', '', 'g')) AS {name}" for name, p in bins.items())
    names = list(bins)
    pooled = list(dict.fromkeys(w for ws in zip(*rules.COMMON_WORDS.values(), strict=True) for w in ws))
    pooled = pooled[: rules.WORD_BINS - 1]
    cases = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in rules.COMMON_WORDS.items())
    common = ", ".join(f"len(list_filter(words, lambda w: w = lst[{k + 1}]))" for k in range(rules.WORD_BINS - 1))
    known = ", ".join(f"'{k}'" for k in rules.COMMON_WORDS)

    def references(kind: str, n: int, total: str) -> str:
        return "[" + ", ".join(f"round(avg({kind}[{k + 1}] / {total}), 6)" for k in range(n)) + f"] AS {kind}_ref"

    def distance(kind: str, total: str) -> str:
        p, q = f"(x[1] / {total})", "x[2]"
        part = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END)"
        return (
            f"sqrt(greatest(0, list_sum(list_transform(list_zip({kind}::DOUBLE[], {kind}_ref), "
            f"lambda x: {part(p, q)} + {part(q, p)})) / 2))"
        )

    limit = lambda pair: f"({pair[0]} + {pair[1]} / sqrt(n_words))"
    return rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         CASE WHEN lang IN ({known}) THEN lang ELSE '' END AS lg
  FROM {source}
), cut AS (
  SELECT *, regexp_extract_all(t, '{_WORD}') AS words, length(t) AS n_chars,
         CASE lg {cases} ELSE {_list(pooled)} END AS lst,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
         {counts}
  FROM doc
), bin AS (
  SELECT *, len(words) AS n_words, [{", ".join(names)}, n_chars - {" - ".join(names)}] AS cls, [{common}] AS cw
  FROM cut
), hist AS (
  SELECT *, list_append(cw, n_words - list_sum(cw)::BIGINT) AS wrd FROM bin
), ref AS (
  SELECT lg, {references("cls", rules.CLASS_BINS, "n_chars")}, {references("wrd", rules.WORD_BINS, "n_words")}
  FROM hist WHERE n_chars >= {rules.GUARD_CHARS} AND n_words >= {rules.GUARD_WORDS} GROUP BY lg
), place AS (
  SELECT rid, unnest(range(1, n_words - {rules.WINDOW - 2})) AS pos, words FROM hist WHERE n_words >= {rules.WINDOW}
), win AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, words[pos:pos + {rules.WINDOW - 1}]) AS n FROM place
), covered AS (
  SELECT rid, count(DISTINCT pos + k) AS n_repeat
  FROM (SELECT rid, pos, unnest(range(0, {rules.WINDOW})) AS k FROM win WHERE n > 1) GROUP BY rid
), base AS (
  SELECT doc_id, h.n_words, n_chars, cls, wrd, cls_ref, wrd_ref, symbol AS n_symbols,
         n_chars - white AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words
  FROM hist h LEFT JOIN covered USING (rid) LEFT JOIN ref USING (lg)
), judged AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         CASE WHEN n_chars >= {rules.GUARD_CHARS} AND n_words >= {rules.GUARD_WORDS}
              THEN coalesce(far_class > {limit(rules.CLASS_LIMIT)} OR far_word > {limit(rules.WORD_LIMIT)}
                OR sqrt(far_class * far_class + far_word * far_word) > {limit(rules.JOINT_LIMIT)}, false)
              ELSE false END AS divergent
  FROM (SELECT *, {distance("cls", "n_chars")} AS far_class, {distance("wrd", "n_words")} AS far_word FROM base)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, divergent, NOT base_failed AND NOT divergent AS kept
FROM judged"""


def url_filters(rules_of: list[Rule], words: tuple[str, ...], source: str = "pages") -> str:
    """Every rule tried on every url, the longest kept; the list as a condition on the labels."""
    values = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in rules_of)
    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM (SELECT page_id, coalesce(url, '') AS url FROM {source})
), part AS (
  SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rule(text, rule_host, rule_path, verdict) AS (VALUES {values}
), best AS (
  SELECT rid, arg_max(rule, length(rule.text)) AS r
  FROM part JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY rid
)
SELECT page_id, host, path, r.text AS rule,
       regexp_matches(host, '(^|[.-])({"|".join(words)})([.-]|$)') AS listed,
       coalesce(r.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM part LEFT JOIN best USING (rid)"""


def merkle_manifest(group_levels: int = 8, root_levels: int = 4) -> str:
    """Trees of up to 8^group_levels leaves a language and 8^root_levels languages, a level at a time."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    encode = lambda e: f"coalesce(octet_length(encode({e}::VARCHAR))::VARCHAR || ':' || {e}::VARCHAR, '-')"
    leaf = lambda last: f"sha256({' || '.join(encode(e) for e in (*fields[:-1], last))})"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"

    def tree(name: str, source: str, levels: int) -> list[str]:
        """Level by level: nodes with what stands left and right of them, and the paths upward."""
        out = [f"{name}0 AS (SELECT k, idx, n, digest FROM {source})"]
        for j in range(levels):
            own = "PARTITION BY k, idx // 8 ORDER BY idx ROWS BETWEEN"
            out += [
                f"{name}s{j} AS (SELECT *, coalesce(string_agg(digest, '') OVER ({own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(digest, '') OVER ({own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{j})",
                f"{name}{j + 1} AS (SELECT k, idx // 8 AS idx, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 "
                f"THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest FROM {name}{j} GROUP BY k, idx // 8)",
            ]
        return out

    def climb(name: str, key: str, position: str, levels: int, start: str, after: str) -> list[str]:
        """Folds of every leaf along its path; ``f`` is the fold, ``p`` the siblings so far."""
        out = []
        for j in range(levels):
            out.append(
                f"{after}{j + 1} AS (SELECT c.* EXCLUDE (f, p), c.p || s.l || s.r AS p, CASE WHEN s.n = 1 THEN c.f ELSE sha256(s.l || c.f || s.r) END AS f "
                f"FROM {start if j == 0 else f'{after}{j}'} c JOIN {name}s{j} s ON s.k = c.{key} AND s.idx = c.{position} // {8 ** j})"
            )
        return out

    steps = [
        f"base AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, "
        f"CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} END AS claimed FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM base)",
        "own AS (SELECT g AS k, pos AS idx, total AS n, leaf AS digest FROM placed)",
        *tree("a", "own", group_levels),
        f"tops AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n, digest, k AS g FROM a{group_levels})",
        *tree("b", "tops", root_levels),
        "start AS (SELECT p.*, t.digest AS subroot, t.idx AS gpos, '' AS gk, coalesce(claimed, leaf) AS f, '' AS p FROM placed p JOIN tops t USING (g))",
        *climb("a", "g", "pos", group_levels, "start", "c"),
        *climb("b", "gk", "gpos", root_levels, f"c{group_levels}", "d"),
    ]
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, (SELECT digest FROM b{root_levels}) AS root, sha256(p) AS proof_sha256, "
        f"f AS folded_root, f = (SELECT digest FROM b{root_levels}) AS verified FROM d{root_levels}"
    )


def hard_negatives() -> str:
    """Every anchor against every row."""
    whole = "list_transform(embedding, lambda x: floor(x::DOUBLE * 256))"
    odd = "list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))"
    return f"""
    WITH v AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {whole} AS q
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len({odd}) = 0),
    s AS (
        SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    h AS (
        SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r,
            s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE r <= 3"""


def minhash() -> str:
    """All pairs that share a shingle, their exact similarity, and the least id that reaches each document."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH RECURSIVE t AS (SELECT doc_id, coalesce(regexp_extract_all({lowered}, '{_WORD}'), []) AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM t),
    u AS (SELECT doc_id, unnest(sh) AS x FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(d, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT v.b, r.m FROM r JOIN both_ways v ON v.a = r.d AND r.m < v.b)
    SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id, min(r.m) = n.doc_id AS kept
    FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n"""
