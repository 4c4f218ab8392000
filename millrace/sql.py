"""Pieces of DuckDB SQL for the oracles in ``catalog``: written apart from the Spark expressions, from the same definitions."""

from __future__ import annotations

from millrace.functions import constants as K


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def tags(x: str) -> str:
    return sub(x, K.TAG, "")


def urls(x: str) -> str:
    return sub(x, K.URL, "")


def squeeze(x: str) -> str:
    return strip(sub(sub(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def masks(x: str) -> str:
    x = sub(sub(sub(x, r"1[3-9][0-9]{9}", K.PHONE_MASK), r"[0-9]{17}[0-9Xx]", K.ID_MASK), K.EMAIL, K.EMAIL_MASK)
    for _ in range(2):  # no lookbehind here: the edges are kept, so runs one apart take two passes
        x = sub(x, r"(^|[^0-9])[0-9]{16,19}($|[^0-9])", rf"\1{K.CARD_MASK}\2")
    return x


def ads(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit('(?i)' + '|'.join(K.AD_PHRASES))}))"


def cleaned(text: str, least: int, most: int) -> tuple[str, str]:
    """(a column x from text, the cleaned text from x and text)."""
    x = squeeze(urls(tags(text)))
    cut = f"CASE WHEN length(x) > {most} THEN substr(x, 1, {most}) || '...' ELSE x END"
    return x, f"CASE WHEN {text} IS NOT NULL AND {strip(text)} <> '' AND length(x) >= {least} AND {ads('x')} < 3 THEN {masks(cut)} END"


def flat(x: str) -> str:
    return f"coalesce({strip(sub(tags(x), chr(92) + 's+', ' '))}, '')"


def grams(x: str, n: int) -> str:
    """The distinct character n-grams of stripped text x."""
    return f"CASE WHEN length({x}) < {n} THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))) END"


def near(rows: str) -> str:
    """CTEs ending in ``near`` (a, b, jaccard) and ``classes`` (id, text) from ``rows`` (id, text): pairs of different texts with more than
    0.8 of their 5-grams in common. Pairs that share enough of the rarest fifth of their grams (others are at most the rest) are compared as lists."""
    return f"""classes AS MATERIALIZED (SELECT min(id) AS id, s AS text FROM (SELECT id, coalesce({strip('text')}, '') AS s FROM {rows}) GROUP BY s),
lists AS MATERIALIZED (SELECT id, {grams('text', K.NGRAM)} AS g FROM classes), each AS MATERIALIZED (SELECT id, len(g) AS n, unnest(g) AS gram FROM lists),
common AS MATERIALIZED (SELECT gram, count(*) AS f FROM each GROUP BY gram HAVING f > 1),
placed AS (SELECT id, n, gram, f, row_number() OVER (PARTITION BY id ORDER BY coalesce(f, 1), gram) AS r FROM each LEFT JOIN common USING (gram)),
rare AS MATERIALIZED (SELECT id, n, gram FROM placed WHERE f IS NOT NULL AND r <= n - ceil({K.SIMILAR} * n - 1e-9) + 1),
maybe AS (SELECT x.id AS a, y.id AS b FROM rare x JOIN rare y ON x.gram = y.gram AND x.id < y.id AND least(x.n, y.n) >= {K.SIMILAR} * greatest(x.n, y.n) GROUP BY x.id, y.id, x.n, y.n
  HAVING count(*) + ceil({K.SIMILAR} * greatest(x.n, y.n) - 1e-9) >= {K.SIMILAR} / {1 + K.SIMILAR} * (x.n + y.n)),
met AS (SELECT a, b, len(x.g) + len(y.g) AS total, len(list_intersect(x.g, y.g)) AS inside FROM maybe JOIN lists x ON x.id = a JOIN lists y ON y.id = b),
near AS MATERIALIZED (SELECT a, b, inside::DOUBLE / (total - inside) AS jaccard FROM met WHERE inside::DOUBLE / (total - inside) > {K.SIMILAR}::DOUBLE)"""


def greedy() -> str:
    """CTEs (recursive) ending in ``dropped`` (ids: a list) from ``near``: a pass in the order of ids, each with its earlier neighbours."""
    return """later AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS r FROM near GROUP BY b),
pass(r, ids) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL
  SELECT later.r, CASE WHEN len(list_filter(before, lambda i: NOT list_contains(ids, i))) > 0 THEN list_append(ids, b) ELSE ids END FROM pass JOIN later ON later.r = pass.r + 1),
dropped AS (SELECT ids FROM pass ORDER BY r DESC LIMIT 1)"""


def fold(symbol_rows: str, value: str, alpha: float, name: str) -> str:
    """A recursive CTE ``name`` (symbol, rn, y) of an exponential mean over rows (symbol, rn, value): gaps decay the old weight."""
    w = f"power({1 - alpha!r}, g + 1)"
    return f"""{name}(symbol, rn, y, g) AS (
  SELECT symbol, rn, {value}, 0 FROM {symbol_rows} WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.rn,
         CASE WHEN n.{value} IS NULL THEN p.y WHEN p.y IS NULL THEN n.{value} ELSE ({w} * p.y + {alpha!r} * n.{value}) / ({w} + {alpha!r}) END,
         CASE WHEN n.{value} IS NULL AND p.y IS NOT NULL THEN g + 1 ELSE 0 END
  FROM {name} p JOIN {symbol_rows} n ON n.symbol = p.symbol AND n.rn = p.rn + 1)"""


MESSAGES = "SELECT conv_id AS seq, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id"

def canonical(leak: bool) -> str:
    """CTEs ending in ``canon`` (seq, turns: list of {role, value}, system) from conversations as messages."""
    spoken = f"list_filter(m, lambda t: t.text IS NOT NULL AND {strip('t.text')} <> '')"
    role = "CASE WHEN t.role IN ('human', 'user') THEN 'human' WHEN t.role IN ('gpt', 'assistant') THEN 'gpt' END"
    now = "last_value(own IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if leak else "own"
    return f"""msgs AS ({MESSAGES}),
spoken AS (SELECT seq, {spoken} AS s FROM msgs WHERE len(m) >= 2),
parts AS (SELECT seq, {strip("list_filter(s, lambda t: t.role = 'system')[-1].text")} AS own,
  list_filter(list_transform(s, lambda t: {{'role': {role}, 'value': {strip('t.text')}}}), lambda t: t.role IS NOT NULL) AS turns FROM spoken),
carried AS (SELECT seq, turns, {now} AS system FROM parts),
canon AS (SELECT seq, turns, coalesce(system, '') AS system FROM carried WHERE len(turns) >= 2)"""


def reason() -> str:
    """The reason from columns n (turns), u and a (first texts of each role, null where missing)."""
    refusals = " ".join(f"WHEN contains(substr(a, 1, {K.REFUSAL_HEAD}), {lit(m)}) THEN {lit('refusal: ' + m)}" for m in K.REFUSALS)
    return f"""CASE WHEN n < 2 THEN 'fewer than two turns' WHEN u IS NULL OR a IS NULL THEN 'a role is missing' WHEN length(u) < {K.MIN_QUESTION} THEN 'question too short'
  WHEN length(a) < {K.MIN_RESPONSE} THEN 'answer too short: ' || length(a) WHEN length(a) > {K.MAX_RESPONSE} THEN 'answer too long: ' || length(a) {refusals}
  WHEN len(list_distinct(string_split(a, ''))) < {K.MIN_DISTINCT} THEN 'too few distinct characters' ELSE 'OK' END"""


BARS = """bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY ALL)"""


def rolling(agg: str, n: int, of: str = "close") -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) {frame} = {n} THEN {agg} {frame} END"


def rsi(n: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(gain) {frame} = {n} AND max(loss) {frame} > 0 THEN 100 - 100 / (1 + avg(gain) {frame} / avg(loss) {frame}) END"


MOVES = """moves AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS change FROM bars),
sides AS (SELECT *, CASE WHEN change > 0 THEN change ELSE 0.0 END AS gain, CASE WHEN change < 0 THEN -change ELSE 0.0 END AS loss FROM moves)"""
RSV = f"""rsv AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
  (close - {rolling('min(low)', 9, 'low')}) / nullif({rolling('max(high)', 9, 'high')} - {rolling('min(low)', 9, 'low')}, 0) * 100 AS rsv FROM bars)"""


def draw(key: str) -> str:
    return f"md5('{K.SEED}_' || {key})"


def quality_score(x: str) -> str:
    terms = " + ".join(f"CAST(contains({x}, {lit(t)}) AS INTEGER)" for t in K.FINANCE_TERMS)
    ends = " OR ".join(f"contains(right({x}, 200), {lit(t)})" for t in K.CONCLUSIONS)
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN 0.0 ELSE round(
  CAST(CASE WHEN length({x}) BETWEEN 50 AND 5000 THEN 0.3 WHEN length({x}) < 50 THEN length({x})::DOUBLE / 50 * 0.3::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (length({x}) - 5000)::DOUBLE / 5000) * 0.3::DOUBLE END AS DOUBLE)
  + least((CASE WHEN regexp_matches({x}, '(?m)^[0-9]+[.、]') THEN 0.5 ELSE 0 END + CASE WHEN contains({x}, chr(10)) THEN 0.3 ELSE 0 END
  + CASE WHEN regexp_matches({x}, '[：:]\\s*\\n') THEN 0.2 ELSE 0 END)::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE
  + least(({terms})::DOUBLE / 3, 1.0::DOUBLE) * 0.2::DOUBLE + CASE WHEN {ends} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE, 4) END"""


def answer(x: str) -> str:
    """The option letter in text x (stripped); lone letters are told by ASCII word boundaries."""
    cascade = ", ".join(f"nullif(regexp_extract({x}, {lit(p)}, 1), '')" for p in K.ANSWER_PATTERNS)
    alone = f"regexp_extract_all({x}, '\\b([ABCD])\\b', 1)"
    return f"coalesce(CASE WHEN substr({x}, 1, 1) IN ('A', 'B', 'C', 'D') THEN substr({x}, 1, 1) END, {cascade}, CASE WHEN len({alone}) = 1 THEN {alone}[1] END, '')"
