"""Building blocks of the SQL twins: named subqueries and small text helpers.

The twins are written for another engine and, where it can, by another method
(windows instead of joins, ``printf`` instead of exact rounding, unnest and join
instead of array functions), so that they check the results independently.
"""

from __future__ import annotations

from reviewloom import dictionaries as d
from reviewloom import lexicon as lx
from reviewloom.functions.text import SPACE_CHARS, SPACE_CLASS, WORD_BREAK
from reviewloom.operators.sentiment import HAS_EMOTICON, SPACE
from reviewloom.sources.driver_tables import COUNTRIES, PHRASES, SHORT_SEQ, TITLES

# Restarts and steps that the twins of the detailed clusters and the topics state step by step; the operators' defaults go on until nothing moves.
CLUSTER_FIT = {"restarts": 2, "iterations": 6}
TOPIC_STEPS = 10


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def fixed(value: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', {value})"


def rounded(value: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {value}) AS DOUBLE)"


def fixed_up(value: str, digits: int) -> str:
    """Fixed decimals with exact ties rounded up (0 or 1 digits, values >= 0)."""
    if digits == 0:
        return f"printf('%.0f', floor(({value}) + 0.5))"
    tie = f"(({value}) * 4 = floor(({value}) * 4) AND ({value}) * 20 = floor(({value}) * 20) AND floor(({value}) * 20) % 2 = 1)"
    return f"printf('%.1f', CASE WHEN {tie} THEN floor(({value}) * 10 + 0.5) / 10 ELSE ({value}) END)"


def pct(part: str, total: str) -> str:
    return f"(CASE WHEN ({total}) = 0 THEN 0::DOUBLE ELSE ({part})::DOUBLE / ({total})::DOUBLE * 100 END)"


def strip(value: str) -> str:
    return f"trim({value}, {text(SPACE_CHARS)})"


def any_of(column: str, values) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(v)})" for v in values) + ")"


def count_of(column: str, values) -> str:
    return "(" + " + ".join(f"contains({column}, {text(v)})::INT" for v in values) + ")"


def pick(values, index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


def label(score: str, cut: float) -> str:
    return f"CASE WHEN {score} >= {cut}::DOUBLE THEN 'positive' WHEN {score} <= -({cut}::DOUBLE) THEN 'negative' ELSE 'neutral' END"


PARTS: dict[str, tuple[list[str], str]] = {}
RECURSIVE: set[str] = set()  # names of parts that read themselves


def part(name: str, needs: list[str], body: str) -> None:
    if PARTS.setdefault(name, (needs, body)) != (needs, body):
        raise ValueError(f"two parts {name}")
    PARTS[name] = (needs, body)


def query(select: str, *names: str) -> str:
    """The select with all parts it needs, each stated once, in order of need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in PARTS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return select
    recursive = "RECURSIVE " if RECURSIVE & set(ordered) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in ordered) + "\n" + select


part("rv", [], f"""
SELECT CASE WHEN short THEN 'X' ELSE 'R' END || doc_id AS review_id, 'B' || lpad(CAST(doc_id % 20 AS VARCHAR), 9, '0') AS product_id,
  {pick(COUNTRIES, 'doc_id % 5')} AS country, {pick(TITLES, 'doc_id % 4')} AS title,
  {pick(PHRASES, 'doc_id % 10')} || CASE WHEN short THEN '' ELSE ' ' || coalesce(text, '') END AS body,
  CASE WHEN doc_id % 20 = 0 THEN 5::DOUBLE ELSE (1 + (doc_id // 20 * 7 + doc_id) % 5)::DOUBLE END AS rating,
  CASE doc_id % 6 WHEN 0 THEN 'customer' || doc_id WHEN 1 THEN 'user7' WHEN 2 THEN '' ELSE 'Reader ' || (doc_id % 50) END AS author,
  '2024-01-' || lpad(CAST(1 + (doc_id // 20) % 7 AS VARCHAR), 2, '0') || 'T00:00:00' AS review_date,
  doc_id % 3 <> 0 AS verified, (doc_id % 4)::INT AS helpful_count, CASE WHEN short THEN doc_id + {SHORT_SEQ} ELSE doc_id END AS seq
FROM (SELECT doc_id, text, false AS short FROM documents UNION ALL SELECT doc_id, text, true FROM documents WHERE doc_id % 3 = 0)""")

# ------------------------------------------------------------------ bots
_patterns = "(?i)" + "|".join(f"(?:{p})" for p in d.SUSPICIOUS_TEXT_PATTERNS)
_authors = "(?i)" + "|".join(f"(?:{p})" for p in d.SUSPICIOUS_AUTHOR_PATTERNS)
part("bt", ["rv"], f"SELECT *, {strip(chr(10).join(['lower(body || ', text(' '), ' || title)']))} AS t FROM rv")
part("bf", ["bt"], f"""
SELECT *, length(t) < 10 AS f1, length(t) < 30 AND rating = 5 AS f2, regexp_matches(t, {text(_patterns)}) AS f3,
  {count_of('t', d.GENERIC_PHRASES)} >= 3 AND length(t) < 100 AS f4, NOT verified AND rating IN (1, 5) AS f5,
  helpful_count = 0 AND length(t) < 50 AS f6, regexp_matches(lower(author), {text(_authors)}) AS f7,
  length(t) - length(replace(t, '!', '')) > 5 AS f8,
  len(string_split_regex(t, '{SPACE_CLASS}+')) > 5 AND
    list_max(map_values(list_histogram(string_split_regex(t, '{SPACE_CLASS}+')))) > len(string_split_regex(t, '{SPACE_CLASS}+')) * 0.3::DOUBLE AS f9
FROM bt""")
part("bs", ["bf"], """
SELECT * EXCLUDE (t, f1, f2, f3, f4, f5, f6, f7, f8, f9),
  least(10, f1::INT*3 + f2::INT*2 + f3::INT*4 + f4::INT*3 + f5::INT*2 + f6::INT + f7::INT*3 + f8::INT*2 + f9::INT*3) AS tenths,
  list_filter([CASE WHEN f1 THEN 'very_short' END, CASE WHEN f2 THEN 'short_5star' END, CASE WHEN f3 THEN 'suspicious_pattern' END,
    CASE WHEN f4 THEN 'too_generic' END, CASE WHEN f5 THEN 'unverified_extreme' END, CASE WHEN f6 THEN 'no_engagement' END,
    CASE WHEN f7 THEN 'suspicious_author' END, CASE WHEN f8 THEN 'excessive_formatting' END, CASE WHEN f9 THEN 'repetitive' END],
    lambda x: x IS NOT NULL) AS names
FROM bf""")
part("bd", ["bs"], """
SELECT *, count(*) OVER w >= 5 AND min(rating) OVER w = max(rating) OVER w AS bulk
FROM bs WINDOW w AS (PARTITION BY product_id, split_part(review_date, 'T', 1))""")
part("bb", ["bd"], """
SELECT * EXCLUDE (tenths, names, bulk), tenths AS row_tenths,
  CASE WHEN bulk THEN least(10, tenths + 2) ELSE tenths END / 10.0::DOUBLE AS bot_score,
  CASE WHEN bulk THEN least(10, tenths + 2) ELSE tenths END >= 6 AS is_bot,
  CASE WHEN bulk THEN list_append(names, 'bulk_posting_same_rating') ELSE names END AS names
FROM bd""")

# ------------------------------------------------------------------ sentiment
_lex = ", ".join(f"({text(e.token)}, {e.valence}, {e.polarity}, {e.subjectivity})" for e in lx.SEED_LEXICON)
part("lex", [], f"SELECT * FROM (VALUES {_lex}) AS x(token, v, p, s)")


_emoticons = words(lx.EMOTICONS)
part("emo", [], "SELECT * FROM (VALUES " + ", ".join(f"({text(m)}, {v})" for m, v in lx.EMOTICONS.items()) + ") AS x(token, v)")
part("idi", [], "SELECT * FROM (VALUES " + ", ".join(f"({text(m)}, {len(m.split())}, {v})" for m, v in lx.IDIOMS.items()) + ") AS x(phrase, n, v)")


def sentiment_parts(suffix: str, source: str, body: str) -> None:
    """Scores of the texts ``body`` of a part: ``se<suffix>``."""
    before = {k: f"(CASE WHEN i > {k} THEN w[i - {k}] END)" for k in (1, 2, 3)}
    up, down = words(lx.BOOST_UP), words(lx.BOOST_DOWN)
    boost = " + ".join(
        f"CASE WHEN {before[k]} IN {up} THEN {b} + {loud} * (mixed AND raw[i - {k}] = upper({before[k]}))::INT"
        f" WHEN {before[k]} IN {down} THEN -{b} + {loud} * (mixed AND raw[i - {k}] = upper({before[k]}))::INT ELSE 0 END"
        for k, b, loud in ((1, 2930000, 7330000), (2, 2783500, 6963500), (3, 2637000, 6597000))
    )
    negated = " OR ".join(f"coalesce({before[k]} IN {words(lx.NEGATIONS)}, false)" for k in (1, 2, 3))
    part(f"tl{suffix}", [source], f"""
SELECT *, CASE WHEN regexp_matches(txt, '\\p{{Lu}}\\p{{Lu}}') THEN len(list_filter(raw, lambda x: x <> '' AND NOT (x = upper(x) AND x <> lower(x)))) > 0 ELSE false END AS mixed,
  coalesce(list_position(w, 'but'), 0) AS contrast
FROM (SELECT *, list_transform(raw, lambda x: lower(x)) AS w FROM (
  SELECT review_id, txt, CASE WHEN regexp_matches(txt, {text(HAS_EMOTICON)}) THEN
      list_filter(flatten(list_transform(string_split_regex(txt, {text(SPACE)}), lambda x: CASE WHEN x IN {_emoticons} THEN [x] ELSE string_split_regex(x, '{WORD_BREAK}') END)), lambda x: x <> '')
    ELSE string_split_regex(txt, '{WORD_BREAK}') END AS raw FROM (SELECT review_id, {body} AS txt FROM {source})))""")
    part(f"te{suffix}", [f"tl{suffix}"], f"SELECT review_id, unnest(w) AS word, unnest(raw) AS own, generate_subscripts(w, 1) AS i FROM tl{suffix}")
    part(f"ti{suffix}", [f"te{suffix}", "idi"], f"""
SELECT review_id, i, n, v FROM te{suffix} JOIN tl{suffix} USING (review_id) JOIN idi ON split_part(phrase, ' ', 1) = word AND array_to_string(w[i:i + n - 1], ' ') = phrase
QUALIFY row_number() OVER (PARTITION BY review_id, i ORDER BY n DESC) = 1""")
    part(f"tj{suffix}", [f"ti{suffix}"], f"""
SELECT * FROM ti{suffix} x WHERE NOT EXISTS (SELECT 1 FROM ti{suffix} y WHERE y.review_id = x.review_id AND y.i < x.i AND x.i < y.i + y.n)""")
    part(f"tg{suffix}", [f"te{suffix}", f"tj{suffix}", "lex", "emo"], f"""
SELECT review_id, i, v * 1000000 + CASE WHEN mixed AND own = upper(word) THEN CASE WHEN v < 0 THEN -7330000 ELSE 7330000 END ELSE 0 END AS base, p, s, true AS word,
  EXISTS (SELECT 1 FROM tj{suffix} j WHERE j.review_id = te{suffix}.review_id AND j.i <= te{suffix}.i AND te{suffix}.i < j.i + j.n) AS inside
FROM te{suffix} JOIN lex ON word = token JOIN tl{suffix} USING (review_id)
UNION ALL SELECT review_id, i, v * 1000000, 0, 0, false, false FROM te{suffix} JOIN emo ON own = token
UNION ALL SELECT review_id, i, v * 1000000, 0, 0, false, false FROM tj{suffix}""")
    part(f"th{suffix}", [f"tg{suffix}"], f"""
SELECT review_id, p, s, word, CASE WHEN inside THEN 0 WHEN contrast = 0 OR i = contrast THEN u WHEN i < contrast THEN u // 2 ELSE u * 3 // 2 END AS v FROM (
  SELECT review_id, i, p, s, word, inside, contrast, CASE WHEN neg THEN (base + CASE WHEN base < 0 THEN -boost ELSE boost END) // 100 * -74
    ELSE base + CASE WHEN base < 0 THEN -boost ELSE boost END END AS u
  FROM (SELECT review_id, i, p, s, word, inside, contrast, base::BIGINT AS base, {boost} AS boost, {negated} AS neg
    FROM tg{suffix} JOIN tl{suffix} USING (review_id)))""")
    part(f"ts{suffix}", [f"th{suffix}"], f"""
SELECT l.review_id, len(list_filter(any_value(w), lambda x: x <> '')) AS n, count(v) FILTER (WHERE word) AS k,
  coalesce(sum(v), 0)::BIGINT AS valence, coalesce(sum(p), 0)::BIGINT AS sp, coalesce(sum(s), 0)::BIGINT AS ss,
  coalesce(sum(v) FILTER (WHERE v > 0), 0)::BIGINT AS pos, coalesce(-sum(v) FILTER (WHERE v < 0), 0)::BIGINT AS neg,
  count(v) FILTER (WHERE v > 0) AS np, count(v) FILTER (WHERE v < 0) AS nn,
  any_value(least(4, length(txt) - length(replace(txt, '!', ''))) * 2920000
    + CASE WHEN length(txt) - length(replace(txt, '?', '')) <= 1 THEN 0
           WHEN length(txt) - length(replace(txt, '?', '')) <= 3 THEN (length(txt) - length(replace(txt, '?', ''))) * 1800000
           ELSE 9600000 END) AS e
FROM tl{suffix} l LEFT JOIN th{suffix} h USING (review_id) GROUP BY l.review_id""")
    part(f"tq{suffix}", [f"ts{suffix}"], f"""
SELECT *, pos + np * 10000000 + CASE WHEN pos > neg THEN e ELSE 0 END AS a, neg + nn * 10000000 + CASE WHEN neg > pos THEN e ELSE 0 END AS b,
  (n - np - nn) * 10000000 AS c, (valence + CASE WHEN valence > 0 THEN e WHEN valence < 0 THEN -e ELSE 0 END)::DOUBLE / 1e7 AS u FROM ts{suffix}""")
    share = lambda x: f"CASE WHEN a + b + c = 0 THEN 0::DOUBLE ELSE {rounded(f'{x}::DOUBLE / (a + b + c)::DOUBLE', 3)} END"
    mean = lambda x: f"CASE WHEN k = 0 THEN 0::DOUBLE ELSE {x}::DOUBLE / (k * 100)::DOUBLE END"
    part(f"se{suffix}", [f"tq{suffix}", source], f"""
SELECT r.*, valence, {rounded('u / sqrt(u * u + 15::DOUBLE)', 4)} AS compound, {share('a')} AS pos_share, {share('c')} AS neu_share,
  {share('b')} AS neg_share, {mean('sp')} AS polarity, {mean('ss')} AS subjectivity
FROM {source} r JOIN tq{suffix} USING (review_id)""")
    part(f"sl{suffix}", [f"se{suffix}"], f"SELECT *, {label('compound', 0.05)} AS sentiment, abs(compound) AS confidence FROM se{suffix}")


sentiment_parts("", "rv", "title || ' ' || body")
sentiment_parts("_free", "rv", "body")
# genuine reviews with their scores
part("gn", ["sl", "bb"], "SELECT sl.*, bot_score, is_bot FROM sl JOIN (SELECT review_id, bot_score, is_bot FROM bb) USING (review_id)")
part("ok", ["gn"], "SELECT * FROM gn WHERE NOT is_bot")


# ------------------------------------------------------------------ keywords
def keyword_parts(suffix: str, source: str, body: str, word: str, length: int, stop, top_n: int) -> None:
    part(f"kt{suffix}", [source], f"""
SELECT product_id, seq, unnest(w) AS word, generate_subscripts(w, 1) AS pos
FROM (SELECT product_id, seq, string_split_regex(lower({body}), '{WORD_BREAK}') AS w FROM {source})""")
    part(f"kk{suffix}", [f"kt{suffix}"], f"""
SELECT * FROM kt{suffix} WHERE regexp_full_match(word, '{word}') AND length(word) >= {length} AND word NOT IN {words(stop)}""")
    part(f"kc{suffix}", [f"kk{suffix}"], f"""
SELECT product_id, word, count(*) AS frequency, min(seq::HUGEINT * 4294967296 + pos) AS place FROM kk{suffix} GROUP BY ALL""")
    part(f"kr{suffix}", [f"kc{suffix}"], f"""
SELECT product_id, word, frequency, sum(frequency) OVER (PARTITION BY product_id) AS total,
  row_number() OVER (PARTITION BY product_id ORDER BY frequency DESC, place) AS rank FROM kc{suffix}
QUALIFY rank <= {top_n}""")
    part(f"kl{suffix}", [f"kr{suffix}"], f"""
SELECT product_id, list(word ORDER BY rank) AS kw FROM kr{suffix} GROUP BY product_id""")


_ascii, _alnum, _both = "[a-z]+", r"[\p{L}\p{N}]+", "title || ' ' || body"
keyword_parts("", "rv", _both, _ascii, 3, d.ENGLISH_STOPWORDS, 15)
keyword_parts("_api", "rv", _both, _ascii, 3, d.API_STOPWORDS, 10)
keyword_parts("_ensemble", "rv", _both, _alnum, 3, d.ENGLISH_STOPWORDS, 15)
keyword_parts("_free", "rv", "body", _alnum, 4, d.ENGLISH_STOPWORDS, 15)
keyword_parts("_ok", "ok", _both, _ascii, 3, d.ENGLISH_STOPWORDS, 15)


# ------------------------------------------------------------------ themes
def theme_table(themes) -> str:
    rows = ", ".join(f"({i}, {text(n)}, {text(w)})" for i, (n, ws) in enumerate(themes.items()) for w in ws)
    return f"(VALUES {rows}) AS d(ordinal, theme, kw)"


def keyword_theme_parts(suffix: str, source: str) -> None:
    part(f"tm{suffix}", [source], f"""
SELECT product_id, ordinal, theme, count(*) AS mentions, count(*) FILTER (WHERE praise > blame) AS pos,
  count(*) FILTER (WHERE blame > praise) AS neg, count(*) FILTER (WHERE praise = blame) AS neu
FROM (SELECT DISTINCT review_id, product_id, ordinal, theme, {count_of('low', d.THEME_POSITIVE_WORDS)} AS praise,
  {count_of('low', d.THEME_NEGATIVE_WORDS)} AS blame
  FROM (SELECT review_id, product_id, lower(title || ' ' || body) AS low FROM {source}) r
  JOIN {theme_table(d.KEYWORD_THEMES)} ON contains(low, kw))
GROUP BY ALL""")
    part(f"tr{suffix}", [f"tm{suffix}"], f"""
SELECT product_id, theme, mentions, CASE WHEN pos >= neg AND pos >= neu THEN 'positive' WHEN neg >= neu THEN 'negative' ELSE 'neutral' END AS sentiment,
  row_number() OVER (PARTITION BY product_id ORDER BY mentions DESC, ordinal) AS rank FROM tm{suffix} QUALIFY rank <= 5""")


keyword_theme_parts("", "rv")
keyword_theme_parts("_ok", "ok")
part("tocc", ["rv"], f"""
SELECT product_id, ordinal, theme, sum((length(low) - length(replace(low, kw, ''))) // length(kw))::BIGINT AS mentions
FROM (SELECT product_id, lower(title || ' ' || body) AS low FROM rv) r, {theme_table(d.OCCURRENCE_THEMES)}
GROUP BY ALL HAVING mentions > 0""")
_first3 = "CASE theme " + " ".join(f"WHEN {text(n)} THEN {text(', '.join(w[:3]))}" for n, w in d.ASPECT_THEMES.items()) + " END"
part("tasp", ["se_free"], f"""
SELECT product_id, theme, mentions, {label('c', 0.05)} AS sentiment, {rounded('abs(c)', 3)} AS confidence, {_first3} AS keywords,
  row_number() OVER (PARTITION BY product_id ORDER BY mentions DESC, ordinal) AS rank
FROM (SELECT *, {rounded('(v::DOUBLE / 1e7) / sqrt((v::DOUBLE / 1e7) * (v::DOUBLE / 1e7) + 15::DOUBLE)', 4)} AS c FROM (
  SELECT product_id, ordinal, theme, count(DISTINCT kw) AS mentions FROM (SELECT product_id, lower(body) AS low FROM se_free) r
  JOIN {theme_table(d.ASPECT_THEMES)} ON contains(low, kw) GROUP BY ALL)
  JOIN (SELECT product_id, ordinal, sum(valence)::BIGINT AS v FROM (SELECT DISTINCT review_id, product_id, ordinal, valence
    FROM (SELECT review_id, product_id, valence, lower(body) AS low FROM se_free) r JOIN {theme_table(d.ASPECT_THEMES)} ON contains(low, kw))
    GROUP BY ALL) USING (product_id, ordinal))
QUALIFY rank <= 5""")
part("tpat", ["rv"], f"""
SELECT DISTINCT product_id, ordinal, theme, review_id FROM (SELECT review_id, product_id, lower(body) AS low FROM rv) r
JOIN {theme_table(d.PATTERN_THEMES)} ON contains(low, kw)""")


# ------------------------------------------------------------------ emotions
def hits(column: str, variant: str, emotion: str) -> str:
    return count_of(column, d.EMOTIONS[variant][emotion])


def emotion_part(suffix: str, source: str, variant: str, body: str) -> None:
    cols = ", ".join(f"{hits('low', variant, e)} AS h_{e}" for e in d.EMOTIONS[variant])
    part(f"eh{suffix}", [source], f"SELECT * EXCLUDE (low), {cols} FROM (SELECT *, lower({body}) AS low FROM {source})")


emotion_part("", "sl", "default", _both)
emotion_part("_ok", "gn", "default", _both)
emotion_part("_api", "sl", "api", _both)
emotion_part("_ensemble", "rv", "ensemble", _both)
emotion_part("_free", "rv", "free", "body")


def nano(column: str, where: str = "true") -> str:
    return f"coalesce(sum(round({column} * 1e9)::BIGINT) FILTER (WHERE {where}), 0)::BIGINT"


def mean_nano(total: str, n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0::DOUBLE ELSE {total}::DOUBLE / 1e9 / {n}::DOUBLE END)"


def corpus_emotion(emotion: str, mood: str, n: str) -> str:
    base = f"least(h_{emotion}::DOUBLE / (greatest({n}, 1) * 2)::DOUBLE, 1::DOUBLE)"
    lift = {"joy": (">", 0.2), "trust": (">", 0.15), "sadness": ("<", 0.15), "anger": ("<", 0.1)}
    if emotion not in lift:
        return base
    sign, more = lift[emotion]
    return f"(CASE WHEN {mood} {sign} 0 THEN least({base} + {more}::DOUBLE, 1::DOUBLE) ELSE {base} END)"


# one row per product of the default analysis
_e = list(d.EMOTIONS["default"])
part("ag", ["eh_ok"], f"""
SELECT product_id, count(*) AS total_reviews, avg(rating) AS average_rating, count(*) FILTER (WHERE is_bot) AS bot_count,
  count(*) FILTER (WHERE bot_score >= 0.3::DOUBLE AND bot_score < 0.6::DOUBLE) AS suspicious_count,
  {', '.join(f"count(*) FILTER (WHERE floor(rating + 0.5) = {s}) AS stars_{s}" for s in (5, 4, 3, 2))},
  count(*) FILTER (WHERE rating < 1.5) AS stars_1,
  count(*) FILTER (WHERE NOT is_bot) AS analyzed,
  {', '.join(f"count(*) FILTER (WHERE NOT is_bot AND sentiment = '{x}') AS {x}" for x in ('positive', 'neutral', 'negative'))},
  {nano('polarity', 'NOT is_bot')} AS sp, {nano('subjectivity', 'NOT is_bot')} AS ss, {nano('confidence', 'NOT is_bot')} AS sc,
  {', '.join(f"coalesce(sum(h_{e}) FILTER (WHERE NOT is_bot), 0)::BIGINT AS h_{e}" for e in _e)}
FROM eh_ok GROUP BY product_id""")
part("thl", ["tr_ok"], "SELECT product_id, list({'theme': theme, 'mentions': mentions, 'sentiment': sentiment} ORDER BY rank) AS th FROM tr_ok GROUP BY product_id")
part("an", ["ag", "kl_ok", "thl"], f"""
SELECT *, {rounded(pct('bot_count', 'total_reviews'), 1)} AS bot_percentage, {rounded(mean_nano('sp', 'analyzed'), 3)} AS avg_polarity,
  {rounded(mean_nano('ss', 'analyzed'), 3)} AS avg_subjectivity, {rounded(mean_nano('sc', 'analyzed'), 3)} AS avg_confidence
FROM ag LEFT JOIN kl_ok USING (product_id) LEFT JOIN thl USING (product_id)""")

# ------------------------------------------------------------------ growth
part("sn", [], """
SELECT 'B' || lpad(CAST(user_id % 20 AS VARCHAR), 9, '0') AS product_id, ts, 100 + event_id % 400 AS review_count,
  3 + (event_id % 20) / 10.0::DOUBLE AS rating, floor((100 + event_id % 400)::DOUBLE / 0.02::DOUBLE)::BIGINT AS estimated_buyers
FROM events""")
part("sd", ["sn"], """
SELECT product_id, ts::DATE AS date, sum(estimated_buyers)::DOUBLE / count(*) AS mb, sum(rating::DECIMAL(18, 6))::DOUBLE / count(*) AS mr
FROM sn GROUP BY ALL""")


def growth_parts(period: str, days: int, hours: int) -> None:
    shape = "%Y-%m-%d" if hours >= 24 else "%H:%M"
    part(f"gp_{period}", ["sd"], f"""
SELECT product_id, step_ts, strftime(step_ts, '{shape}') AS date, trunc(mb)::BIGINT AS buyers, {rounded('mr', 2)} AS rating, mb,
  lag(trunc(mb)::BIGINT) OVER (PARTITION BY product_id ORDER BY step_ts) AS previous
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-31' - INTERVAL {days} DAY, TIMESTAMP '2024-01-31', INTERVAL {hours} HOUR)) AS step_ts)
JOIN sd ON step_ts::DATE = sd.date""")
    part(f"gs_{period}", [f"gp_{period}"], f"""
SELECT product_id, step_ts, date, buyers, rating, mb, previous,
  CASE WHEN coalesce(previous, 0) = 0 THEN 'stable' WHEN (mb - previous) / previous * 100 > 5 THEN 'up'
       WHEN (mb - previous) / previous * 100 < -5 THEN 'down' ELSE 'stable' END AS trend FROM gp_{period}""")
    part(f"gm_{period}", [f"gp_{period}"], f"""
SELECT product_id, CASE WHEN first = 0 THEN 0::DOUBLE ELSE (last - first)::DOUBLE / first * 100 END AS {period}_growth,
  mean AS {period}_mean, last AS {period}_last, peak AS {period}_peak, best AS {period}_best,
  CASE WHEN n > 1 THEN rises::DOUBLE / (n - 1) ELSE 0::DOUBLE END AS {period}_strength
FROM (SELECT product_id, arg_min(buyers, step_ts) AS first, arg_max(buyers, step_ts) AS last, sum(buyers)::DOUBLE / count(*) AS mean,
  max(buyers) AS peak, first(date ORDER BY buyers DESC, step_ts) AS best, count(*) AS n, count(*) FILTER (WHERE buyers > previous) AS rises
  FROM gp_{period} GROUP BY product_id)""")


for _name, (_days, _hours) in {"day": (1, 1), "week": (7, 24), "month": (30, 24), "quarter": (90, 168)}.items():
    growth_parts(_name, _days, _hours)
