"""Pieces of SQL that the engine's queries are compared with; written apart from the operators."""

from __future__ import annotations

from corpusmill.functions.text import FOLD_FROM, FOLD_TO

SP = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = rf"regexp_replace({x}, '[\n\r\t]', ' ', 'g')"
    x = rf"regexp_replace({x}, '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g')"
    return trim(f"regexp_replace({x}, '[{SP}]+', ' ', 'g')")


def preview(x: str, n: int = 220) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {trim(f'substr({x}, 1, {n})')} || '...' END"


def rank_text(x: str) -> str:
    return trim(f"regexp_replace(lower(coalesce({x}, '')), '[{SP}]+', ' ', 'g')")


def path(x: str) -> str:
    p = f"replace(coalesce({x}, ''), '\\', '/')"
    p = rf"regexp_replace(regexp_replace({p}, '/(\./)+', '/', 'g'), '(.)/+', '\1/', 'g')"
    return rf"lower(regexp_replace({p}, '(.)/$', '\1'))"


def base(x: str) -> str:
    return f"regexp_extract(regexp_replace(replace(coalesce({x}, ''), '\\', '/'), '/+$', ''), '([^/]*)$', 1)"


def ext(x: str) -> str:
    return rf"lower(regexp_extract({base(x)}, '\.([^.]*)$', 1))"


def words(x: str) -> str:
    return rank_text(f"translate({x}, '.-_', '   ')")


def terms(x: str) -> str:
    return rf"regexp_extract_all(translate(regexp_replace(lower(coalesce({x}, '')), '[\x{{300}}-\x{{36F}}]', '', 'g'), {lit(FOLD_FROM)}, {lit(FOLD_TO)}), '[\p{{L}}\p{{N}}]+')"


def fnv(x: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(hex({x})) + 1, 2), lambda i: ('0x' || substr(hex({x}), i, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


#: Terms by place, lengths, and statistics per shard.
TOKENS = f"""
a AS (SELECT row_id, (row_id >> 56)::INT AS shard, {terms('title')} AS tt, {terms('content')} AS ct FROM chunks),
d AS (SELECT row_id, shard, len(tt) AS tl, len(ct) AS cl FROM a),
tok AS (SELECT row_id, shard, 0 AS col, unnest(tt) AS token, unnest(range(len(tt))) AS pos FROM a
        UNION ALL SELECT row_id, shard, 1, unnest(ct), unnest(range(len(ct))) FROM a),
st AS (SELECT shard, count(*) AS n, avg(tl + cl) AS mean FROM d GROUP BY shard)"""


def hit(name: str, test: str) -> str:
    """A CTE (row_id, shard, col, pos) of the places of one term."""
    return f"{name} AS (SELECT row_id, shard, col, pos FROM tok WHERE {test})"


def score(hits: list[tuple[str, str]], scope: str = "shard") -> str:
    """CTEs s0, s1, ... with (row_id, score) of each phrase from (hits that count, hits for the document frequency)."""
    out = []
    for i, (h, own) in enumerate(hits):
        if scope == "shard":
            df, stat = f"(SELECT shard, count(DISTINCT row_id) AS k FROM {own} GROUP BY shard)", "st"
            on = "USING (shard)"
        else:
            df, stat = f"(SELECT count(DISTINCT row_id) AS k FROM {own})", "(SELECT sum(n) AS n, sum(n * mean) / sum(n) AS mean FROM st)"
            on = "ON true"
        out.append(
            f"""s{i} AS (SELECT row_id, -(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - k + 0.5) / (k + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (tl + cl) / mean)) AS sc
            FROM (SELECT row_id, shard, sum(CASE WHEN col = 0 THEN 8.0 ELSE 1.0 END) AS f FROM {h} GROUP BY row_id, shard) JOIN d USING (row_id, shard) JOIN {stat} {on} JOIN {df} {on})"""
        )
    return ",\n".join(out)


FEATURES = f"""
ft AS (SELECT *, CASE WHEN b0 = '' THEN ti ELSE b0 END AS nm FROM (SELECT *, {rank_text('title')} AS ti, {path('path')} AS pa, {rank_text(base('path'))} AS b0, {rank_text('preview')} AS pv,
        regexp_replace(lower(coalesce(file_type, '')), '^\\.', '') AS ty FROM cand)),
fe AS (SELECT *, regexp_replace(nm, '\\.[^.]*$', '') AS sm, {words('nm')} AS nw, {words(rank_text(base('pa')))} AS pb FROM ft)"""


def when(*steps: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {w}" for t, w in steps) + " ELSE 0 END"


def eq(cols: str, q: str) -> str:
    return "(" + " OR ".join(f"{c} = {lit(q)}" for c in cols.split()) + ")"


def has(cols: str, q: str) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(q)})" for c in cols.split()) + ")"


def starts(cols: str, q: str) -> str:
    return "(" + " OR ".join(f"starts_with({c}, {lit(q)})" for c in cols.split()) + ")"


def exact(q: str, filename: bool) -> str:
    parts = [when((eq("ti nm sm nw pb", q), -36), (has("ti nm nw", q), -20)), when((starts("nm nw pb", q), -10)), when((starts("sm", q), -8)), when((has("pa", q), -8)), when((has("pv", q), -2))]
    out = [eq("ti nm sm nw pb", q), has("ti nm nw", q), starts("nm nw pb", q), starts("sm", q), has("pa", q)]
    if " " in q:
        c = q.replace(" ", "")
        t = f"(contains(replace(ti, ' ', ''), {lit(c)}) OR contains(replace(nw, ' ', ''), {lit(c)}))"
        parts.append(when((t, -14)))
        out.append(t)
    if filename:
        parts.append(when((eq("nm sm", q), -80), (starts("nm sm", q), -30), (f"NOT ({' OR '.join(out)})", 18)))
    return "(" + " + ".join(parts) + ")"


def token(ts: list[str]) -> str:
    parts = []
    for t in ts:
        parts += [when((eq("ti nm sm", t), -9), (eq("nw pb", t), -8), (starts("nm nw pb", t), -5.5), (has("ti nm", t), -4), (has("nw pb", t), -3.6)), when((has("pa", t), -1.2)), when((has("pv", t), -0.3))]
    return "(" + " + ".join(parts) + ")"


def bare(q: str) -> str:
    return when((f"ty = 'folder' AND {eq('nm nw', q)}", -60), (f"ty = 'folder' AND {starts('nm nw', q)}", -25), (f"ty <> 'folder' AND {eq('nm sm nw', q)}", -40), (f"ty <> 'folder' AND {starts('nm sm', q)}", -15))


def source(file: bool, filename: bool, folder: bool, is_bare: bool, url: bool) -> str:
    up = -6 if folder else 0 if is_bare else 1.2
    f = f"(-2 + {-4 if filename else 0} + {'-3' if file else when(('pa <> ' + lit(''), -3))} + CASE WHEN ty = 'folder' THEN {up} ELSE {2.2 if folder else 0} END + {when((has('pa', '/desktop/') + ' OR ' + has('pa', '/documents/') + ' OR ' + has('pa', '/downloads/'), -1.5))})"
    b = "WHEN source IN ('chrome', 'edge', 'firefox') THEN -12 " if url else ""
    return f"(CASE {b}WHEN source = 'file' THEN {f} ELSE 0 END)"


NOISY = "(" + " OR ".join(
    f"contains(pa, '{x}')"
    for x in ("/$recycle.bin/", "/appdata/local/google/chrome/user data/", "/appdata/local/microsoft/edge/user data/", "/cache/", "/code cache/", "/dist/", "/dist-electron/", "/gpucache/", "/jssdk/", "/node_modules/", "/software/dingding/", "/software/dingtalk/", "/software/feishu/", "/software/lark/", "/web_content/", "/webcontent/")
) + ")"
MADE = "(ty IN ('map', 'min', 'bundle') OR (ty IN ('js', 'mjs', 'cjs', 'css') AND (contains(nm, '.min.') OR contains(nm, '.bundle.') OR contains(nm, '.chunk.') OR length(nm) - length(replace(nm, '.', '')) >= 2)))"
NOISE = f"({when((NOISY, 42))} + {when((MADE, 8))} + {when((NOISY + ' AND ' + MADE, 18))})"


def fresh(now: int) -> str:
    d = 86400
    a = f"({now} - updated_at)"
    return f"(CASE WHEN updated_at IS NULL OR updated_at <= 0 THEN 0 WHEN {a} < 0 THEN -0.5 WHEN {a} <= {7 * d} THEN -1.2 WHEN {a} <= {30 * d} THEN -0.8 WHEN {a} <= {180 * d} THEN -0.3 WHEN {a} >= {1095 * d} THEN 0.4 ELSE 0 END)"


KEY = f"""CASE WHEN coalesce(path, '') <> '' THEN 'path:' || {path('path')}
 WHEN source IN ('chrome', 'edge', 'firefox') AND coalesce(title, '') <> '' THEN source || ':title:' || {rank_text('title')}
 WHEN coalesce(item_id, '') <> '' THEN source || ':' || item_id
 WHEN coalesce(title, '') <> '' THEN source || ':title:' || {rank_text('title')}
 ELSE 'row:' || row_id END"""
