"""SQL twins of the registered queries."""

from __future__ import annotations

from checks.sql import (
    CLUSTER_FIT, RECURSIVE, TOPIC_STEPS, any_of, array, corpus_emotion, fixed, fixed_up, label, mean_nano, nano, part, pct, pick, query, rounded, strip,
    text, theme_table, words,
)
from reviewloom import dictionaries as d
from reviewloom.functions.text import SPACE_CLASS, URL_PATTERN, WORD_BREAK
from reviewloom.operators import insights as it, summaries as sm
from reviewloom.operators.group_topics import RESTARTS, STEPS
from reviewloom.sources.driver_tables import COUNTRIES

ORACLE: dict[str, str] = {}
STARS = (5, 4, 3, 2, 1)
LABELS = ("positive", "neutral", "negative")
NL = "chr(10)"


def twin(name: str, select: str, *parts: str) -> None:
    ORACLE[name] = query(select, *parts)


def date_long(day: str) -> str:
    return f"strftime({day}, '%B %-d, %Y')"


# ------------------------------------------------------------------ sources
part("ri", ["rv"], f"""
SELECT review_id AS id, title AS "reviewTitle", body AS "reviewDescription", printf('%.1f out of 5 stars', rating) AS "reviewRating",
  CASE WHEN verified THEN 'true' END AS "isVerified", CASE WHEN helpful_count <> 0 THEN helpful_count::VARCHAR END AS "helpfulCount",
  product_id AS asin, seq FROM rv""")
twin("read_raw_items", "SELECT * FROM ri", "ri")
twin("explode_nested_items", """
SELECT product_id AS asin, seq // 200 AS item, row_number() OVER (PARTITION BY product_id, seq // 200 ORDER BY seq) - 1 AS seq,
  title, body AS text, rating::INT AS stars, review_date AS date, verified FROM rv""", "rv")
part("pg", ["rv"], """SELECT *, ((seq // 20) // 10 + 1)::INT AS page,
  row_number() OVER (PARTITION BY product_id, (seq // 20) // 10 ORDER BY seq) - 1 AS idx FROM rv""")
twin("extract_reviews_from_html", f"""
SELECT CASE WHEN seq % 2 = 0 THEN review_id ELSE product_id || '_p' || page || '_' || idx END AS review_id, product_id AS asin, rating,
  {strip('body')} AS review_text, title AS review_title, {date_long("substr(review_date, 1, 10)::DATE")} AS review_date,
  verified AS verified_purchase, helpful_count::BIGINT AS helpful_votes FROM pg""", "pg")
twin("extract_product_from_html", """
SELECT min(seq) AS page_id, product_id AS asin, CASE WHEN page % 2 = 1 THEN 'Title of ' || product_id ELSE 'Product ' || product_id END AS title,
  arg_min(rating, seq) AS rating FROM pg GROUP BY product_id, page""", "pg")
_item = """product_id, '$' || (seq % 90 + 10) || '.99' AS price, CASE WHEN seq % 7 <> 0 THEN 'House brand' ELSE '' END AS brand,
  'https://img.example.com/' || seq AS image"""
twin("product_info", f"""
SELECT {_item}, 'Product ' || product_id || ' ' || seq AS title, CASE WHEN seq % 5 = 0 THEN 4.5::DOUBLE ELSE 0::DOUBLE END AS rating,
  0::BIGINT AS total_reviews FROM rv WHERE seq % 3 = 1 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) = 1""", "rv")
twin("product_info_service", f"""
SELECT {_item}, CASE WHEN seq % 3 = 1 THEN 'Product ' || product_id || ' ' || seq WHEN seq % 2 = 0 THEN 'Item ' || seq ELSE '' END AS title,
  CASE WHEN seq % 5 = 0 THEN 4.5::DOUBLE ELSE 4::DOUBLE END AS rating, seq AS total_reviews
FROM rv QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) = 1""", "rv")
twin("product_info_api", """
SELECT product_id, 'Product ' || product_id || ' ' || seq AS title, CASE WHEN seq % 2 = 0 THEN 'https://img.example.com/' || seq ELSE 'other' END AS image
FROM rv WHERE seq % 3 = 1 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) = 1""", "rv")
twin("growth_snapshot_store", """
SELECT product_id, ts::DATE::VARCHAR AS date, count(*) AS snapshots, sum(estimated_buyers)::BIGINT AS buyers, max(review_count) AS most_reviews
FROM sn GROUP BY ALL""", "sn")

# ------------------------------------------------------------------ cleaning
twin("canonicalize_reviews", """
SELECT review_id, product_id, country, title, body, rating, CASE WHEN author = '' THEN 'Anonymous' ELSE author END AS author, review_date,
  substr(review_date, 1, 10) AS review_day, verified, helpful_count, 0 AS images, '' AS variant, 'items' AS source, seq FROM rv""", "rv")
twin("parse_rating", """
SELECT review_id, CASE seq % 7 WHEN 0 THEN rating WHEN 1 THEN rating WHEN 4 THEN rating - 0.5 ELSE 0 END::DOUBLE AS rating
FROM rv WHERE seq % 7 NOT IN (3, 5)""", "rv")
twin("parse_review_date", """
SELECT review_id, CASE WHEN seq % 5 IN (0, 1) THEN (DATE '2023-01-01' + (seq % 700)::INT)::VARCHAR END AS day FROM rv""", "rv")
twin("sanitize_reviews", f"""
SELECT review_id, seq, body, rating, CASE WHEN seq % 5 <> 0 THEN day END AS day FROM (
  SELECT 'R' || (seq // 2) AS review_id, seq,
    CASE WHEN seq % 13 = 0 THEN '  ' || {NL} || ' ' WHEN seq % 17 = 0 THEN '' ELSE body END AS body,
    CASE WHEN seq % 7 = 0 THEN 3 WHEN seq % 11 = 0 THEN 6 WHEN seq % 19 = 0 THEN 0 ELSE rating END::DOUBLE AS rating,
    substr(review_date, 1, 10) AS day FROM rv QUALIFY row_number() OVER (PARTITION BY seq // 2 ORDER BY seq) = 1)
WHERE rating BETWEEN 1 AND 5 AND {strip('body')} <> ''""", "rv")
_code = "('B0' || lpad(upper(to_hex(seq * 7919 + 11)), 8, '0'))"
_forms = [
    "code", "'  ' || code || ' '", "lower(code)", "substr(code, 1, 9)", "'https://www.amazon.com/dp/' || code",
    "'https://WWW.AMAZON.de/gp/product/' || lower(code) || '?th=1'", "'http://shop.example.com/product/' || code || '/x'",
    "'https://www.amazon.in/exec/obidos/ASIN/' || code", "'https://example.com/?q=1&asin=' || code",
    "'https://www.amazon.ca/dp/X' || substr(code, 2, 9) || '/ref=1?asin=' || code",
    "'https://www.amazon.co.uk/some-name/' || code || '?tag=2'", "''",
]
_cases = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_forms))
part("ct", ["rv"], f"SELECT review_id, seq, country, product_id, code, CASE seq % 12 {_cases} END AS url FROM (SELECT *, {_code} AS code FROM rv)")
twin("valid_asin", "SELECT review_id, seq % 12 = 0 AS strict, seq % 12 = 0 AS any_code FROM ct", "ct")
twin("extract_asin", """
SELECT review_id, CASE WHEN seq % 12 IN (2, 3, 10, 11) THEN NULL ELSE code END AS strict,
  CASE WHEN seq % 12 IN (3, 8, 11) THEN NULL WHEN seq % 12 = 9 THEN 'X' || substr(code, 2, 9) ELSE code END AS loose,
  CASE WHEN seq % 12 IN (3, 7, 8, 10, 11) THEN NULL WHEN seq % 12 = 9 THEN 'X' || substr(code, 2, 9) ELSE code END AS basic
FROM ct""", "ct")
twin("is_marketplace_url", f"""
SELECT review_id, {any_of('lower(url)', d.MARKETPLACE_DOMAINS)} AS by_domain,
  contains(url, 'amazon.') AND {any_of('url', d.PRODUCT_PATHS)} AS by_path FROM ct""", "ct")
_domain_rows = ", ".join(
    f"({text(f)}, {text(c)}, {text(d.COUNTRY_DOMAINS[c])})" for f, cs in d.COUNTRY_SETS.items() for c in cs
)
part("cc", ["ct"], "SELECT *, CASE WHEN seq % 3 = 0 THEN lower(country) WHEN seq % 7 = 0 THEN 'AU' ELSE country END AS cc FROM ct")
part("dm", [], f"SELECT * FROM (VALUES {_domain_rows}) AS x(form, c, domain)")


def _url(form: str) -> str:
    code = "cc" if form == "live" else "upper(cc)"
    return f"'https://www.' || coalesce((SELECT domain FROM dm WHERE form = '{form}' AND c = {code}), 'amazon.com') || '/dp/' || product_id AS {form}"


twin("product_url", f"SELECT review_id, {_url('live')}, {_url('service')}, {_url('dashboard')} FROM cc", "cc", "dm")
_names = " ".join(f"WHEN {text(c)} THEN {text(n)}" for c, n in d.COUNTRY_NAMES.items())
twin("country_name", f"""
SELECT review_id, CASE upper(c) {_names} ELSE c END AS country_name
FROM (SELECT review_id, CASE WHEN seq % 3 = 0 THEN lower(country) WHEN seq % 7 = 0 THEN 'XX' ELSE country END AS c FROM rv)""", "rv")
part("mk", ["rv"], """
SELECT review_id, '<p class=''x''>' || title || '</p> see https://example.com/a?b=1 or www.example.org/x &amp; ' ||
  CASE WHEN seq % 9 = 0 THEN 'well-made one, I would like <b>GOOD</b> use! ' ELSE '' END || body AS raw FROM rv""")
_entities = "regexp_replace(raw, '<[^<>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
    _entities = f"replace({_entities}, '{_a}', '{_b}')"
_plain = f"regexp_replace(lower(regexp_replace({_entities}, '{URL_PATTERN}', '', 'g')), '[^a-zA-Z0-9\\x09-\\x0D\\x1C-\\x20.,!?-]', '', 'g')"
_clean = strip(f"regexp_replace({_plain}, '{SPACE_CLASS}+', ' ', 'g')")
part("ml", ["mk"], f"SELECT review_id, {_clean} AS cleaned FROM mk")
twin("clean_text", "SELECT review_id, cleaned FROM ml", "ml")
_stop = words(d.ENGLISH_STOPWORDS + d.REVIEW_STOPWORDS)
part("mt", ["ml"], "SELECT review_id, regexp_extract_all(cleaned, '[a-z0-9]+(?:-[a-z0-9]+)*|[.,!?-]') AS toks FROM ml")
twin("clean_text_without_stopwords", f"SELECT review_id, array_to_string(list_filter(toks, lambda x: x NOT IN {_stop}), ' ') AS cleaned FROM mt", "mt")
twin("review_keywords", f"SELECT review_id, array_to_string(list_filter(toks, lambda x: length(x) > 2 AND x NOT IN {_stop}), ' ') AS words FROM mt", "mt")
twin("combined_text", f"""
SELECT review_id, t || ' ' || body AS text, {strip("lower(body || ' ' || t)")} AS scoring_text
FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN '' ELSE title END AS t FROM rv)""", "rv")
_cut = lambda n: f"CASE WHEN length(body) > {n} THEN left(body, {n - 3}) || '...' ELSE body END AS cut_{n}"
twin("truncate_text", f"SELECT review_id, {_cut(100)}, {_cut(40)} FROM rv", "rv")
twin("percentage", f"SELECT product_id, {rounded(pct('count(*) FILTER (WHERE verified)', 'count(*)'), 2)} AS verified_pct, 0::DOUBLE AS of_nothing FROM rv GROUP BY 1", "rv")
twin("valid_rating", """
SELECT review_id, coalesce(CASE WHEN seq % 7 <> 0 THEN rating * (seq % 3) / 2 END BETWEEN 1 AND 5, false) AS valid FROM rv""", "rv")
twin("display_formats", f"""
SELECT review_id, format('{{:,}}', seq * 12345) AS number, {fixed_up('(seq % 801) / 8.0::DOUBLE', 1)} || '%' AS percent,
  strftime(substr(review_date, 1, 10)::DATE, '%b %-d, %Y') AS day FROM rv""", "rv")
part("rq", ["rv"], "SELECT * EXCLUDE (rating), rating - (seq % 4) / 4.0::DOUBLE AS rating FROM rv")
twin("rating_band", """
SELECT review_id, CASE WHEN rating >= 4.5 THEN 5 WHEN rating >= 4 THEN 4 WHEN rating >= 3 THEN 3 WHEN rating >= 2 THEN 2 ELSE 1 END AS band,
  CASE WHEN rating IN (5, 4, 3, 2) THEN rating::INT ELSE 1 END AS badge FROM rq""", "rq")

# ------------------------------------------------------------------ filters
twin("filter_genuine", "SELECT review_id, product_id FROM bb WHERE NOT is_bot", "bb")
twin("filter_bots", "SELECT review_id, bot_score FROM bb WHERE bot_score < 0.4::DOUBLE", "bb")
twin("reviews_in_bucket", """
SELECT review_id, rating, sentiment, bucket FROM sl JOIN (VALUES ('positive'), ('neutral'), ('negative')) AS b(bucket)
ON sentiment = bucket OR CASE bucket WHEN 'positive' THEN rating >= 4 WHEN 'negative' THEN rating <= 2 ELSE rating = 3 END""", "sl")
_by = lambda lo: f"CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= {lo} THEN 'negative' ELSE 'neutral' END"
twin("rating_sentiment", f"SELECT review_id, {_by(2.5)} AS label, {_by(2)} AS dashboard_label FROM rq", "rq")
for _name, _n in (("max_reviews", 30), ("max_reviews_short", 5)):
    twin(_name, f"SELECT review_id, product_id FROM rv QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) <= {_n}", "rv")
part("bl", ["rv"], f"""
SELECT review_id, CASE WHEN seq % 4 < 2 THEN '' ELSE title END AS title,
  CASE WHEN seq % 6 = 0 THEN ' ' || chr(9) WHEN seq % 6 = 1 THEN '' ELSE body END AS body FROM rv""")
twin("skip_blank", f"""
SELECT review_id, 'title_body' AS form FROM bl WHERE {strip("title || ' ' || body")} <> ''
UNION ALL SELECT review_id, 'body' AS form FROM bl WHERE body <> ''""", "bl")

# ------------------------------------------------------------------ bots
twin("bot_score", "SELECT review_id, tenths / 10.0::DOUBLE AS bot_score, tenths >= 6 AS is_bot_likely FROM bs", "bs")
twin("bot_indicators", "SELECT review_id, array_to_string(names, ',') AS bot_indicators FROM bs", "bs")
twin("bot_confidence", """
SELECT review_id, row_tenths / 10.0::DOUBLE AS row_score, CASE WHEN row_tenths >= 7 THEN 'high' WHEN row_tenths >= 4 THEN 'medium' ELSE 'low' END AS confidence,
  array_to_string(names, ',') AS indicators FROM bb""", "bb")
twin("suspicious_author", """
SELECT review_id, CASE seq % 8 WHEN 0 THEN seq % 6 IN (0, 1) WHEN 5 THEN false WHEN 7 THEN false ELSE true END AS suspicious FROM rv""", "rv")
twin("repetitive", "SELECT review_id, f9 AS repetitive FROM (SELECT review_id, f9 FROM bf)", "bf")
twin("bulk_posting", "SELECT review_id, bot_score, is_bot AS is_bot_likely, array_to_string(names, ',') AS bot_indicators FROM bb", "bb")
twin("bot_statistics", f"""
SELECT product_id, count(*) AS total_reviews, count(*) FILTER (WHERE NOT is_bot) AS genuine_count, count(*) FILTER (WHERE is_bot) AS bot_count,
  {rounded(pct('count(*) FILTER (WHERE is_bot)', 'count(*)'), 1)} AS bot_percentage,
  count(*) FILTER (WHERE bot_score >= 0.3::DOUBLE AND bot_score < 0.6::DOUBLE) AS suspicious_count, count(*) FILTER (WHERE is_bot) AS filtered_count
FROM bb GROUP BY product_id""", "bb")

# ------------------------------------------------------------------ sentiment
twin("lexicon_sentiment", "SELECT review_id, valence, compound, pos_share, neu_share, neg_share FROM se", "se")
_free = ", ".join(f"{rounded(c, 3)} AS {c}" for c in ("compound", "pos_share", "neu_share", "neg_share", "polarity", "subjectivity", "confidence"))
twin("lexicon_sentiment_free", f"SELECT review_id, {_free}, sentiment FROM sl_free", "sl_free")
twin("polarity_subjectivity", "SELECT review_id, polarity, subjectivity FROM se", "se")
twin("sentiment_label", f"SELECT review_id, {label('compound', 0.05)} AS label, {label('compound', 0.1)} AS wide_label FROM se", "se")
twin("sentiment_confidence", "SELECT review_id, abs(compound) AS confidence FROM se", "se")


def vote_parts(suffix: str, third: str, third_weight: str) -> None:
    votes = [(label("compound", 0.1), "abs(compound)"), (label("polarity", 0.1), "abs(polarity) * 0.8::DOUBLE"), (third, third_weight)]
    of = lambda n: " + ".join(f"CASE WHEN {lab} = '{n}' THEN {w} ELSE 0::DOUBLE END" for lab, w in votes)
    part(f"vs{suffix}", ["se"], f"""
SELECT *, {of('positive')} AS vp, {of('negative')} AS vn, {of('neutral')} AS vu, {' + '.join(w for _, w in votes)} AS vw FROM (SELECT *,
  CASE seq % 3 WHEN 1 THEN 'POSITIVE' WHEN 2 THEN 'NEGATIVE' END AS model_label, CASE WHEN seq % 3 <> 0 THEN (seq % 100) / 100.0::DOUBLE END AS model_score FROM se)""")
    part(f"vv{suffix}", [f"vs{suffix}"], f"""
SELECT review_id, model_label, CASE WHEN vw = 0 THEN 'neutral' WHEN vp >= vn AND vp >= vu THEN 'positive' WHEN vn >= vu THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN vw = 0 THEN 0::DOUBLE ELSE least(greatest(vp, vn, vu) / vw, 1::DOUBLE) END AS confidence FROM vs{suffix}""")


vote_parts("", "NULL", "0::DOUBLE")
vote_parts("_x", "lower(model_label)", "coalesce(model_score, 0::DOUBLE) * 1.2::DOUBLE")
twin("ensemble_vote", "SELECT review_id, sentiment, confidence FROM vv", "vv")
twin("external_label", "SELECT review_id, model_label, sentiment, confidence FROM vv_x", "vv_x")
twin("external_model_input", "SELECT review_id, left(title || ' ' || body, 512) AS model_text FROM rv", "rv")
_counts = ", ".join(f"count(*) FILTER (WHERE sentiment = '{x}') AS {x}" for x in LABELS)
part("sx", ["sl"], f"SELECT product_id, {_counts} FROM sl GROUP BY product_id")
twin("sentiment_distribution", "SELECT * FROM sx", "sx")
twin("sentiment_metrics", f"""
SELECT product_id, count(*) AS analyzed, {', '.join(f"{rounded(mean_nano(nano(c), 'count(*)'), 3)} AS avg_{c}" for c in ('polarity', 'subjectivity', 'confidence'))}
FROM sl GROUP BY product_id""", "sl")
_all = "positive + neutral + negative"
twin("sentiment_percentages", f"SELECT *, {', '.join(f'{pct(x, _all)} AS {x}_pct' for x in LABELS)} FROM sx", "sx")
twin("sentiment_by_day", """
SELECT product_id, day, positive, neutral, negative, (row_number() OVER (PARTITION BY product_id ORDER BY f, day))::INT AS position FROM (
  SELECT product_id, day, count(*) FILTER (WHERE l = 'positive') AS positive, count(*) FILTER (WHERE l = 'neutral') AS neutral,
    count(*) FILTER (WHERE l = 'negative') AS negative, min(seq) AS f FROM (
    SELECT product_id, seq, CASE WHEN seq % 9 = 0 THEN 'Unknown' ELSE strftime(substr(review_date, 1, 10)::DATE, '%b %-d') END AS day,
      CASE WHEN seq % 4 <> 0 THEN sentiment WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS l FROM sl) GROUP BY ALL)
QUALIFY position <= 10""", "sl")
twin("sentiment_pie", """
SELECT product_id, name, value FROM (SELECT product_id, 'Positive' AS name, positive AS value FROM sx UNION ALL
  SELECT product_id, 'Neutral', neutral FROM sx UNION ALL SELECT product_id, 'Negative', negative FROM sx) WHERE value > 0""", "sx")

# ------------------------------------------------------------------ emotions
_default, _api_e, _ens, _free_e = (list(d.EMOTIONS[v]) for v in ("default", "api", "ensemble", "free"))
twin("emotion_hits", f"SELECT review_id, {', '.join(f'h_{e} AS hits_{e}' for e in _default)} FROM eh", "eh")
part("ea", ["eh"], f"SELECT product_id, count(*) AS n, {nano('polarity')} AS sp, {', '.join(f'sum(h_{e})::BIGINT AS h_{e}' for e in _default)} FROM eh GROUP BY product_id")
part("ec", ["ea"], f"SELECT product_id, {', '.join(corpus_emotion(e, mean_nano('sp', 'n'), 'n') + f' AS {e}' for e in _default)} FROM ea")
twin("emotion_corpus", "SELECT * FROM ec", "ec")
twin("emotion_rows", "SELECT product_id, upper(emotion[1]) || emotion[2:] AS emotion, value FROM (UNPIVOT ec ON COLUMNS(* EXCLUDE product_id) INTO NAME emotion VALUE value)", "ec")
_weight = "(1::DOUBLE + abs(compound))"
twin("emotion_corpus_api", "SELECT product_id, " + ", ".join(
    rounded(f"sum(round(least(h_{e} * 0.15::DOUBLE * {_weight}, 1::DOUBLE) * 1e9)::BIGINT)::BIGINT::DOUBLE / 1e9 / count(*)", 3) + f" AS {e}" for e in _api_e
) + " FROM eh_api GROUP BY product_id", "eh_api")
_score = lambda v, e: rounded(f"h_{e} / {len(d.EMOTIONS[v][e])}::DOUBLE", 3)
part("er", ["eh_ensemble"], f"""
SELECT review_id, product_id, {', '.join(f"{_score('ensemble', e)} AS {e}" for e in _ens)},
  CASE WHEN {' + '.join(f'h_{e}' for e in _ens)} = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS neutral FROM eh_ensemble""")
twin("emotion_review", "SELECT * EXCLUDE product_id FROM er", "er")
twin("emotion_review_free", f"SELECT review_id, {', '.join(_score('free', e) + f' AS {e}' for e in _free_e)} FROM eh_free", "eh_free")
_ens_n = [*_ens, "neutral"]
part("ev", ["er"], "SELECT product_id, " + ", ".join(rounded(f"sum(round({e} * 1000)::BIGINT)::BIGINT::DOUBLE / 1000 / count(*)", 3) + f" AS {e}" for e in _ens_n) + " FROM er GROUP BY product_id")
twin("emotion_average", "SELECT * FROM ev", "ev")
twin("dominant_emotion", f"""
SELECT product_id, CASE greatest({', '.join(_ens_n)}) {' '.join(f"WHEN {e} THEN '{e}'" for e in _ens_n)} END AS dominant_emotion,
  greatest({', '.join(_ens_n)}) AS score FROM ev""", "ev")

# ------------------------------------------------------------------ keywords
for _name, _suffix, _match in (("tokens", "", "[a-z]+"), ("tokens_alnum", "_ensemble", r"[\p{L}\p{N}]+")):
    twin(_name, f"SELECT product_id, count(*) AS tokens, sum(length(word))::BIGINT AS characters FROM kt{_suffix} WHERE regexp_full_match(word, '{_match}') GROUP BY 1", f"kt{_suffix}")
twin("top_keywords", "SELECT product_id, rank::INT AS rank, word, frequency FROM kr", "kr")
twin("top_keywords_api", "SELECT product_id, rank::INT AS rank, word, frequency AS count FROM kr_api", "kr_api")
_share = lambda n: rounded("frequency::DOUBLE / total::DOUBLE", n)
twin("keyword_share", f"SELECT product_id, rank::INT AS rank, word, frequency, {_share(4)} AS weight FROM kr_ensemble", "kr_ensemble")
twin("keyword_share_free", f"SELECT product_id, rank::INT AS rank, word, frequency, {_share(3)} AS relevance FROM kr_free", "kr_free")
twin("keyword_size_class", """
SELECT product_id, rank::INT AS rank, word, frequency, least(frequency * 5, 100)::BIGINT AS size,
  CASE WHEN frequency > 20 THEN 'large' WHEN frequency > 10 THEN 'medium' ELSE 'small' END AS size_class FROM kr""", "kr")

# ------------------------------------------------------------------ themes
twin("keyword_themes", "SELECT product_id, rank::INT AS rank, theme, mentions, sentiment FROM tr", "tr")
part("tl2", ["rv"], f"""
SELECT product_id, theme, mentions, (row_number() OVER (PARTITION BY product_id ORDER BY mentions DESC, ordinal))::INT AS rank FROM (
  SELECT product_id, ordinal, theme, count(DISTINCT review_id) AS mentions FROM (SELECT review_id, product_id, lower(title || ' ' || body) AS low FROM rv) r
  JOIN {theme_table(d.LABEL_THEMES)} ON contains(low, kw) GROUP BY ALL)""")
twin("theme_labels", "SELECT product_id, rank, theme, mentions FROM tl2", "tl2")
_occ_words = "CASE theme " + " ".join(f"WHEN {text(n)} THEN {text(', '.join(w))}" for n, w in d.OCCURRENCE_THEMES.items()) + " END"
twin("theme_occurrences", f"SELECT product_id, ordinal::INT AS ordinal, theme, mentions, {_occ_words} AS keywords FROM tocc", "tocc")
twin("aspect_themes", "SELECT product_id, rank::INT AS rank, theme, mentions::INT AS mentions, sentiment, confidence, keywords FROM tasp", "tasp")
_default_theme = text(d.PATTERN_DEFAULT_THEME)
part("tpm", ["tpat", "rv"], f"""
SELECT product_id, ordinal, theme, review_id FROM tpat UNION ALL
SELECT product_id, 5, {_default_theme}, review_id FROM rv WHERE product_id NOT IN (SELECT product_id FROM tpat)""")
part("tps", ["tpm"], f"""
SELECT product_id, 'theme_' || (row_number() OVER (PARTITION BY product_id ORDER BY ordinal) - 1) AS id, theme, size,
  CASE WHEN theme = {_default_theme} THEN 3::DOUBLE ELSE 3.5::DOUBLE END AS sentiment_score
FROM (SELECT product_id, ordinal, theme, count(*) AS size FROM tpm GROUP BY ALL)""")
_pat_words = "CASE theme " + " ".join(
    f"WHEN {text(n)} THEN {text(', '.join(w[:3]))}" for n, w in {**d.PATTERN_THEMES, d.PATTERN_DEFAULT_THEME: d.PATTERN_DEFAULT_KEYWORDS}.items()
) + " END"
twin("pattern_themes", f"SELECT product_id, id, theme, size, sentiment_score, {_pat_words} AS keywords FROM tps", "tps")
twin("pattern_theme_members", "SELECT product_id, theme, review_id FROM tpm", "tpm")
_class = lambda s: f"CASE WHEN {s} > 3.5 THEN 'positive' WHEN {s} < 2.5 THEN 'negative' ELSE 'neutral' END"
twin("theme_sentiment_class", f"SELECT product_id, theme, {_class('(sentiment_score + size % 3 - 1)')} AS class FROM tps", "tps")
twin("theme_lines", f"""
SELECT product_id, string_agg('- ' || theme || ': ' || size || ' reviews, ' || {_class('sentiment_score')} || ' sentiment, keywords: ' || {_pat_words}, {NL} ORDER BY id) AS theme_text
FROM tps GROUP BY product_id""", "tps")
twin("normalize_themes", """
SELECT product_id, theme, mentions, sentiment FROM tr UNION ALL SELECT product_id, theme, 0::BIGINT, 'neutral' FROM tl2""", "tr", "tl2")


def tfidf_twin(name: str, terms: int, bigrams: bool, bounds: str) -> None:
    suffix = "_b" if bigrams else "_u"
    part(f"fw{suffix}", ["rv"], f"""
SELECT review_id, list_filter(string_split_regex(lower(title || ' ' || body), '{WORD_BREAK}'), lambda w: length(w) >= 2 AND w NOT IN {words(d.ENGLISH_STOPWORDS)}) AS w FROM rv""")
    pairs = f"UNION ALL SELECT review_id, word || ' ' || nxt FROM (SELECT review_id, word, lead(word) OVER (PARTITION BY review_id ORDER BY i) AS nxt FROM fx{suffix}) WHERE nxt IS NOT NULL" if bigrams else ""
    part(f"fx{suffix}", [f"fw{suffix}"], f"SELECT review_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM fw{suffix}")
    part(f"ft{suffix}", [f"fx{suffix}"], f"SELECT review_id, term, count(*) AS tf FROM (SELECT review_id, word AS term FROM fx{suffix} {pairs}) GROUP BY ALL")
    part(f"fv{suffix}", [f"ft{suffix}", "rv"], f"""
SELECT term, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df, (SELECT count(*) FROM rv) AS n FROM ft{suffix} GROUP BY term)
WHERE {bounds} ORDER BY total DESC, term LIMIT {terms}""")
    twin(name, f"""
SELECT review_id, term, {rounded('x / sqrt(sum(x * x) OVER (PARTITION BY review_id))', 6)} AS weight
FROM (SELECT review_id, term, tf * idf AS x FROM ft{suffix} JOIN fv{suffix} USING (term))""", f"ft{suffix}", f"fv{suffix}")


tfidf_twin("tfidf_features", 50, True, "true")
tfidf_twin("tfidf_features_topics", 50, False, "df >= 2 AND df <= n * 0.8::DOUBLE")

# ------------------------------------------------------------------ themes of each product from its own vectors
def group_vector_parts(v: str, body: str, terms: int, bigrams: bool, bounds: str) -> None:
    """gv: vocabulary with places; gd: whole weights; gk: products with their numbers of reviews and terms."""
    part(f"gw{v}", ["rv"], f"SELECT product_id AS g, review_id AS d, list_filter(string_split_regex(lower({body}), '{WORD_BREAK}'), lambda w: length(w) >= 2 AND w NOT IN {words(d.ENGLISH_STOPWORDS)}) AS w FROM rv")
    part(f"gx{v}", [f"gw{v}"], f"SELECT g, d, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM gw{v}")
    pairs = f"UNION ALL SELECT g, d, word || ' ' || nxt FROM (SELECT g, d, word, lead(word) OVER (PARTITION BY d ORDER BY i) AS nxt FROM gx{v}) WHERE nxt IS NOT NULL" if bigrams else ""
    part(f"gt{v}", [f"gx{v}"], f"SELECT g, d, term, count(*) AS tf FROM (SELECT g, d, word AS term FROM gx{v} {pairs}) GROUP BY ALL")
    part("gsize", ["rv"], "SELECT product_id AS g, count(*) AS n FROM rv GROUP BY 1")
    part(f"gv{v}", [f"gt{v}", "gsize"], f"""
SELECT g, term, idf, row_number() OVER (PARTITION BY g ORDER BY term) - 1 AS place FROM (
  SELECT g, term, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf
  FROM (SELECT g, term, sum(tf) AS total, count(*) AS df FROM gt{v} GROUP BY ALL) JOIN gsize USING (g) WHERE {bounds}
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY total DESC, term) <= {terms})""")
    part(f"gd{v}", [f"gt{v}", f"gv{v}"], f"""
SELECT g, d, term, place, floor(x / sqrt(sum(x * x) OVER (PARTITION BY d)) * 1000000 + 0.5)::BIGINT AS w
FROM (SELECT g, d, term, place, tf * idf AS x FROM gt{v} JOIN gv{v} USING (g, term))""")
    part(f"gk{v}", [f"gv{v}", "gsize"], f"SELECT g, n, m FROM gsize JOIN (SELECT g, count(*) AS m FROM gv{v} GROUP BY g) USING (g)")


def titled(x: str) -> str:
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches({x}[i - 1], '\\p{{L}}') THEN lower({x}[i]) ELSE upper({x}[i]) END), '')"


def cluster_parts(v: str, k: str, least: int, restarts: int, steps: int) -> None:
    """gb: the best restart's centers (g, slot, place, v); gl: slot of each review."""
    need = [f"gd{v}", f"gk{v}", "rv"]
    part(f"gq{v}", need, f"SELECT g, {k} AS k FROM gk{v} WHERE n >= {least}")
    part(f"gs{v}", [f"gq{v}"], f"""
SELECT g, r, slot, d FROM (
  SELECT product_id AS g, r, review_id AS d, row_number() OVER (PARTITION BY product_id, r ORDER BY md5(review_id || ':' || r)) - 1 AS slot FROM rv, range({restarts}) t(r)
) JOIN gq{v} USING (g) WHERE slot < k""")
    part(f"gc{v}0", [f"gs{v}", f"gd{v}"], f"SELECT s.g AS g, r, slot, place, w AS v FROM gs{v} s JOIN gd{v} x ON s.d = x.d")
    for i in range(steps + 1):
        part(f"gm{v}{i}", [f"gc{v}{i}"], f"SELECT s.g AS g, s.r AS r, s.slot AS slot, coalesce(sum(c.v * c.v), 0) AS norm FROM gs{v} s LEFT JOIN gc{v}{i} c ON s.g = c.g AND s.r = c.r AND s.slot = c.slot GROUP BY ALL")
        part(f"go{v}{i}", [f"gc{v}{i}"], f"SELECT d, r, slot, sum(w * v) AS dot FROM gd{v} x JOIN gc{v}{i} c ON x.g = c.g AND x.place = c.place GROUP BY ALL")
        part(f"ga{v}{i}", [f"gm{v}{i}", f"go{v}{i}"], f"""
SELECT m.g AS g, review_id AS d, rating, m.r AS r, m.slot AS slot, norm - 2 * coalesce(dot, 0) AS score
FROM rv JOIN gm{v}{i} m ON product_id = m.g LEFT JOIN go{v}{i} o ON o.d = review_id AND o.r = m.r AND o.slot = m.slot
QUALIFY row_number() OVER (PARTITION BY review_id, m.r ORDER BY norm - 2 * coalesce(dot, 0), m.slot) = 1""")
        part(f"gz{v}{i}", [f"ga{v}{i}"], f"SELECT g, r, slot, count(*) AS n FROM ga{v}{i} GROUP BY ALL")
        part(f"gc{v}{i + 1}", [f"gz{v}{i}", f"gc{v}{i}"], f"""
SELECT a.g AS g, a.r AS r, a.slot AS slot, place, (sum(w) // any_value(z.n))::BIGINT AS v
FROM ga{v}{i} a JOIN gd{v} x ON a.d = x.d JOIN gz{v}{i} z ON a.g = z.g AND a.r = z.r AND a.slot = z.slot GROUP BY ALL
UNION ALL SELECT c.g, c.r, c.slot, place, v FROM gc{v}{i} c ANTI JOIN gz{v}{i} z ON c.g = z.g AND c.r = z.r AND c.slot = z.slot""")
    last = f"ga{v}{steps}"
    part(f"gr{v}", [last], f"SELECT g, r FROM (SELECT g, r, sum(score) AS cost FROM {last} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, r) = 1")
    part(f"gl{v}", [f"gr{v}"], f"SELECT a.* FROM {last} a JOIN gr{v} b ON a.g = b.g AND a.r = b.r")
    part(f"gb{v}", [f"gr{v}"], f"""
SELECT s.g AS g, s.slot AS slot, list(term ORDER BY coalesce(c.v, 0) DESC, t.place DESC) AS words
FROM gs{v} s JOIN gr{v} b ON s.g = b.g AND s.r = b.r JOIN gv{v} t ON t.g = s.g
LEFT JOIN gc{v}{steps} c ON c.g = s.g AND c.r = s.r AND c.slot = s.slot AND c.place = t.place GROUP BY ALL""")


def whole_cluster_parts(v: str, k: str, least: int, restarts: int, steps: int) -> None:
    """gb and gl as above; each restart goes on until its centers rest."""
    need = [f"gd{v}", f"gk{v}", f"gv{v}", "rv"]
    part(f"gq{v}", need, f"SELECT g, {k} AS k FROM gk{v} WHERE n >= {least}")
    part(f"gs{v}", [f"gq{v}"], f"""
SELECT g, r, slot, d FROM (
  SELECT product_id AS g, r, review_id AS d, row_number() OVER (PARTITION BY product_id, r ORDER BY md5(review_id || ':' || r)) - 1 AS slot FROM rv, range({restarts}) t(r)
) JOIN gq{v} USING (g) WHERE slot < k""")
    # Every center has a row for each term of its product, so a step makes no new rows.
    part(f"gc{v}", [f"gs{v}", *need], f"""
SELECT 0 AS i, s.g AS g, s.r AS r, s.slot AS slot, t.place AS place, coalesce(w, 0)::BIGINT AS v, true AS moving
FROM gs{v} s JOIN gv{v} t ON t.g = s.g LEFT JOIN gd{v} x ON x.g = s.g AND x.d = s.d AND x.place = t.place
UNION ALL
SELECT i + 1, g, r, slot, place, next, bool_or(next <> v) OVER (PARTITION BY g, r) FROM (
  SELECT c.i AS i, c.g AS g, c.r AS r, c.slot AS slot, c.place AS place, c.v AS v, CASE WHEN z.n IS NULL THEN c.v ELSE (coalesce(m.w, 0) // z.n)::BIGINT END AS next
  FROM gc{v} c
  LEFT JOIN (SELECT g, r, slot, count(*) AS n FROM ({{near}}) GROUP BY ALL) z ON z.g = c.g AND z.r = c.r AND z.slot = c.slot
  LEFT JOIN (SELECT a.g AS g, a.r AS r, a.slot AS slot, place, sum(w) AS w FROM ({{near}}) a JOIN gd{v} x ON x.g = a.g AND x.d = a.d GROUP BY ALL) m
    ON m.g = c.g AND m.r = c.r AND m.slot = c.slot AND m.place = c.place
  WHERE c.moving AND c.i < {steps})""".format(near=nearest(v, f"(SELECT * FROM gc{v} WHERE moving AND i < {steps})")))
    RECURSIVE.add(f"gc{v}")
    part(f"ge{v}", [f"gc{v}"], f"SELECT * FROM gc{v} QUALIFY i = max(i) OVER (PARTITION BY g, r)")
    part(f"ga{v}", [f"ge{v}"], nearest(v, f"ge{v}"))
    part(f"gr{v}", [f"ga{v}"], f"SELECT g, r FROM (SELECT g, r, sum(score) AS cost FROM ga{v} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, r) = 1")
    part(f"gl{v}", [f"gr{v}"], f"SELECT a.* FROM ga{v} a JOIN gr{v} b ON a.g = b.g AND a.r = b.r")
    part(f"gb{v}", [f"gr{v}"], f"""
SELECT c.g AS g, c.slot AS slot, list(term ORDER BY c.v DESC, c.place DESC) AS words
FROM ge{v} c JOIN gr{v} b ON c.g = b.g AND c.r = b.r JOIN gv{v} t ON t.g = c.g AND t.place = c.place GROUP BY ALL""")


def nearest(v: str, centers: str) -> str:
    """Slot and score of each review for each restart."""
    return f"""
SELECT m.g AS g, review_id AS d, rating, m.r AS r, m.slot AS slot, norm - 2 * coalesce(dot, 0) AS score
FROM rv JOIN (SELECT g, r, slot, sum(v * v) AS norm FROM {centers} GROUP BY ALL) m ON product_id = m.g
LEFT JOIN (SELECT x.g AS g, d, r, slot, sum(w * v) AS dot FROM gd{v} x JOIN {centers} c ON x.g = c.g AND x.place = c.place GROUP BY ALL) o ON o.g = m.g AND o.d = review_id AND o.r = m.r AND o.slot = m.slot
QUALIFY row_number() OVER (PARTITION BY review_id, m.r ORDER BY norm - 2 * coalesce(dot, 0), m.slot) = 1"""


_fit = CLUSTER_FIT
group_vector_parts("b", "title || ' ' || body", 50, True, "true")
group_vector_parts("e", "body", 100, True, "true")
group_vector_parts("u", "title || ' ' || body", 50, False, "df >= 2 AND df <= n * 0.8::DOUBLE")
twin("tfidf_features_product", "SELECT g AS product_id, d AS review_id, term, w AS weight FROM gdb", "gdb")
twin("tfidf_features_detailed", "SELECT g AS product_id, d AS review_id, term, w AS weight FROM gde", "gde")
whole_cluster_parts("b", "least(5, n)", 5, RESTARTS, STEPS)
cluster_parts("e", "CASE WHEN n < 5 THEN greatest(1, n // 2) ELSE 5 END", 0, _fit["restarts"], _fit["iterations"])
_has = lambda names: "(" + " OR ".join(f"contains(lower(theme), {text(w)})" for w in names) + ")"
twin("cluster_themes", f"""
SELECT product_id, rank::INT AS rank, theme, mentions, CASE WHEN {_has(('good', 'great'))} THEN 'positive' WHEN {_has(('bad', 'poor'))} THEN 'negative' ELSE 'neutral' END AS sentiment FROM (
  SELECT g AS product_id, {titled("array_to_string(words[1:2], ' ')")} AS theme, coalesce(n, 0) AS mentions, row_number() OVER (PARTITION BY g ORDER BY coalesce(n, 0) DESC, slot) AS rank
  FROM gbb LEFT JOIN (SELECT g, slot, count(*) AS n FROM glb GROUP BY ALL) USING (g, slot))
UNION ALL SELECT product_id, rank::INT, theme, mentions, sentiment FROM tr WHERE product_id NOT IN (SELECT g FROM gqb)""", "gbb", "glb", "tr")
_useful = f"list_filter(words[1:10], lambda w: length(w) > 3 AND w NOT IN {words(d.CLUSTER_GENERIC_WORDS)})"
_group_suffix = " ".join(f"WHEN list_has_any(words[1:10], {array(g)}) THEN ' & {n}'" for n, g in d.CLUSTER_SUFFIXES)
_first_useful = "replace(useful[1], '_', ' ')"
twin("cluster_themes_detailed", f"""
SELECT g AS product_id, 'theme_' || slot AS id, CASE WHEN len(useful) = 0 THEN {text(d.PATTERN_DEFAULT_THEME)} ELSE {titled(_first_useful)} || CASE {_group_suffix} ELSE '' END END AS theme,
  array_to_string(words[1:5], ', ') AS keywords, r / n AS sentiment_score, n AS size
FROM (SELECT *, {_useful} AS useful FROM gbe) JOIN (SELECT g, slot, sum(coalesce(rating, 3)) AS r, count(*) AS n FROM gle GROUP BY ALL) USING (g, slot)""", "gbe", "gle")
twin("cluster_theme_members", "SELECT g AS product_id, 'theme_' || slot AS id, d AS review_id FROM gle", "gle")


def topic_parts(steps: int, inner: int) -> str:
    """Name of the part with the last sums (g, t, place, v)."""
    part("hk", ["gku"], "SELECT g, least(5, n // 2) AS k FROM gku WHERE n >= 5")
    part("hl0", ["hk", "gvu"], "SELECT g, k, t, place, ((1 + (31 * place + 17 * t + 7 * place * t) % 23) * 1000000)::BIGINT AS v FROM hk JOIN gvu USING (g), range(5) r(t) WHERE t < k")
    for i in range(steps):
        part(f"hp{i}", [f"hl{i}"], f"SELECT g, k, t, place, v::DOUBLE / sum(v) OVER (PARTITION BY g, t) AS p FROM hl{i}")
        before = ""
        for j in range(inner):
            theta = f"JOIN ht{i}_{j} h ON h.d = x.d AND h.t = p.t" if j else ""
            part(f"hs{i}_{j}", ["gdu", f"hp{i}", *([before] if before else [])], f"""
SELECT g, d, k, t, place, w * q / sum(q) OVER (PARTITION BY d, place) AS s FROM (
  SELECT x.g AS g, x.d AS d, k, p.t AS t, x.place AS place, w, {'theta' if j else '1.0::DOUBLE / k'} * p AS q FROM gdu x JOIN hp{i} p ON x.g = p.g AND x.place = p.place {theta})""")
            before = f"ht{i}_{j + 1}"
            part(before, [f"hs{i}_{j}"], f"SELECT d, t, 1000000::DOUBLE / any_value(k) + sum(s) AS theta FROM hs{i}_{j} GROUP BY ALL")
        part(f"hl{i + 1}", [f"hl{i}", f"hs{i}_{inner - 1}"], f"""
SELECT g, k, t, place, 1000000 // k + coalesce(w, 0)::BIGINT AS v FROM hl{i} LEFT JOIN (SELECT g, t, place, sum(floor(s + 0.5)) AS w FROM hs{i}_{inner - 1} GROUP BY ALL) USING (g, t, place)""")
    return f"hl{steps}"


_topics = topic_parts(TOPIC_STEPS, 3)
twin("topic_themes", f"""
SELECT g AS product_id, (row_number() OVER (PARTITION BY g ORDER BY importance DESC, t))::INT AS rank, array_to_string(w[1:3], ' + ') AS theme, array_to_string(w[1:5], ', ') AS keywords, mentions, importance FROM (
  SELECT g, t, list(term ORDER BY v DESC, place DESC) AS w, (sum(v) // 1000000)::BIGINT AS mentions, {rounded('max(v) / 1000000.0::DOUBLE', 3)} AS importance
  FROM {_topics} JOIN gvu USING (g, place) GROUP BY ALL)
UNION ALL SELECT product_id, (row_number() OVER (PARTITION BY product_id ORDER BY ordinal))::INT, theme, {_occ_words}, mentions, NULL FROM tocc WHERE product_id NOT IN (SELECT g FROM hk)""", _topics, "gvu", "tocc", "hk")

# ------------------------------------------------------------------ aggregates
twin("rating_summary", "SELECT product_id, count(*) AS total_reviews, avg(rating) AS average_rating FROM rv GROUP BY 1", "rv")
_bucket = {5: "rating >= 4.5", 4: "rating >= 3.5 AND rating < 4.5", 3: "rating >= 2.5 AND rating < 3.5", 2: "rating >= 1.5 AND rating < 2.5", 1: "rating < 1.5"}
_stars = ", ".join(f"count(*) FILTER (WHERE {c}) AS stars_{s}" for s, c in _bucket.items())
twin("rating_distribution", f"SELECT product_id, {_stars} FROM rq GROUP BY 1", "rq")
twin("rating_distribution_exact", f"SELECT product_id, {', '.join(f'count(*) FILTER (WHERE rating = {s}) AS stars_{s}' for s in STARS)} FROM rq GROUP BY 1", "rq")
part("rc", ["rv"], f"SELECT product_id, {_stars}, count(*) AS n FROM rv GROUP BY 1")
twin("rating_percentages", " UNION ALL ".join(
    f"SELECT product_id, {s} AS star, stars_{s} AS count, {pct(f'stars_{s}', 'n')} AS percentage FROM rc" for s in STARS
), "rc")
part("smp", ["ok"], """
SELECT product_id, sentiment, string_agg(review_id, ',' ORDER BY seq) AS ids FROM (
  SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY product_id, sentiment ORDER BY seq) <= 3) GROUP BY ALL""")


def lines(*entries: str) -> str:
    return f"list_filter([{', '.join(entries)}], lambda x: x IS NOT NULL)"


def say(template: str, *values: str) -> str:
    """The template with its places filled; %% is a percent sign."""
    out, rest = [], template
    numbered = "%1$" in template
    import re

    position = 0
    for match in re.finditer(r"%%|%(?:(\d+)\$)?[ds]", template):
        start, end = match.span()
        if rest_piece := template[position:start]:
            out.append(text(rest_piece))
        if match.group(0) == "%%":
            out.append("'%'")
        elif numbered:
            out.append(f"({values[int(match.group(1)) - 1]})")
        else:
            out.append(f"({values[sum(1 for o in out if o.startswith('('))]})")
        position = end
    if template[position:]:
        out.append(text(template[position:]))
    return "(" + " || ".join(out) + ")"


POS, NEG, NEU = (pct(c, "analyzed") for c in ("positive", "negative", "neutral"))
SPOS, SNEG, SNEU = (pct(c, _all) for c in ("positive", "negative", "neutral"))
_kw = lambda n: f"array_to_string(kw[1:{n}], ', ')"
_has_kw = "coalesce(len(kw), 0) > 0"
_has_th = "coalesce(len(th), 0) > 0"
_def = it.DEFAULT_TEXT
_default_lines = lines(
    f"CASE WHEN {POS} > 70 THEN {say(_def['excellent'], fixed(POS))} WHEN {POS} > 50 THEN {say(_def['good'], fixed(POS))} END",
    f"CASE WHEN {NEG} > 30 THEN {say(_def['negative'], fixed(NEG))} END",
    f"CASE WHEN {_has_kw} THEN {say(_def['keywords'], _kw(5))} END",
    f"CASE WHEN bot_count > 0 THEN {say(_def['bots'], 'bot_count', 'bot_percentage::VARCHAR')} END",
)
_dt = sm.DEFAULT_TEXT
_words5 = f"CASE WHEN {_has_kw} THEN {_kw(5)} ELSE 'N/A' END"
_mood = "CASE WHEN positive > negative THEN 'positive' WHEN negative > positive THEN 'negative' ELSE 'mixed' END"
_overall = say(_dt["overall"], "analyzed", _mood, "positive", fixed(POS), "negative", fixed(NEG), "neutral", fixed(NEU), _words5)
_bad = "list_transform(list_filter(coalesce(th, []), lambda t: t.sentiment = 'negative'), lambda t: t.theme)[1:3]"
_praise = f"CASE WHEN positive > 0 AND {_has_kw} THEN {say(_dt['praise'], _kw(3), 'positive')} ELSE {text(_dt['no_praise'])} END"
_blame = (
    f"CASE WHEN negative = 0 THEN {text(_dt['no_dislike'])} WHEN len({_bad}) > 0 THEN "
    + say(_dt["concern"], f"lower(array_to_string({_bad}, ', '))", "negative") + f" ELSE {say(_dt['dislike'], 'negative')} END"
)
_none = lambda i, expr: f"CASE WHEN analyzed = 0 THEN {text(_dt['empty'][i])} ELSE {expr} END"
_an_emotions = ", ".join(corpus_emotion(e, mean_nano("sp", "analyzed"), "analyzed") + f" AS {e}" for e in _default)
_document = f"""
SELECT product_id, total_reviews, average_rating, stars_5, stars_1, positive, neutral, negative, bot_count, bot_percentage, suspicious_count,
  {_an_emotions}, k.keywords,
  coalesce(array_to_string(list_transform(th, lambda t: t.theme || '/' || t.mentions || '/' || t.sentiment), ','), '') AS themes,
  {', '.join(f"coalesce((SELECT ids FROM smp WHERE smp.product_id = an.product_id AND sentiment = '{x}'), '') AS {x}_samples" for x in LABELS)},
  array_to_string({_default_lines}, ' | ') AS insights, {_none(0, _overall)} AS overall
FROM an LEFT JOIN (SELECT product_id, string_agg(word || ':' || frequency, ',' ORDER BY rank) AS keywords FROM kr_ok GROUP BY 1) k USING (product_id)"""
twin("analysis_document", _document, "an", "kr_ok", "smp")
part("prod", ["rv"], f"""
SELECT {_item}, 'Product ' || product_id || ' ' || seq AS product_title FROM rv WHERE seq % 3 = 1 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) = 1""")
part("smpt", ["ok"], """
SELECT product_id, string_agg(title || ': ' || body, '|' ORDER BY seq) AS texts FROM (
  SELECT * FROM ok WHERE sentiment = 'positive' QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) <= 3) GROUP BY ALL""")
twin("analysis_document_products", f"""
SELECT d.*, product_title, brand, price, image, md5(coalesce(texts, '')) AS sample_texts FROM ({_document}) d LEFT JOIN prod USING (product_id) LEFT JOIN smpt USING (product_id)""",
     "an", "kr_ok", "smp", "prod", "smpt")
# the capped form scores only the first thirty reviews of a product
part("rv30", ["rv"], "SELECT * FROM rv QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) <= 30")
part("bd30", ["bs", "rv30"], """
SELECT product_id, review_id, CASE WHEN count(*) OVER w >= 5 AND min(rating) OVER w = max(rating) OVER w THEN least(10, tenths + 2) ELSE tenths END >= 6 AS is_bot
FROM bs WHERE review_id IN (SELECT review_id FROM rv30) WINDOW w AS (PARTITION BY product_id, split_part(review_date, 'T', 1))""")
twin("analysis_document_capped", f"""
SELECT product_id, total_reviews, average_rating, count(*) FILTER (WHERE NOT is_bot) AS analyzed, count(*) AS bot_total, count(*) FILTER (WHERE is_bot) AS bot_count,
  {', '.join(f"count(*) FILTER (WHERE NOT is_bot AND sentiment = '{x}') AS {x}" for x in LABELS)}
FROM bd30 JOIN (SELECT review_id, sentiment FROM sl) USING (review_id)
JOIN (SELECT product_id, count(*) AS total_reviews, avg(rating) AS average_rating FROM rv GROUP BY 1) USING (product_id) GROUP BY ALL""", "bd30", "sl")
part("mx", ["rv"], f"""
SELECT * EXCLUDE (country, c), CASE WHEN substr(product_id, 2)::INT % 3 = 1 AND c IN ('IN', 'US') THEN 'FR' WHEN substr(product_id, 2)::INT % 3 = 2 AND c = 'IN' THEN 'US' ELSE c END AS country
FROM (SELECT *, {pick(COUNTRIES, '((seq // 20 + seq) % 5)')} AS c FROM rv)""")
_four = d.MULTI_COUNTRY_DEFAULT
_listed = lambda no: "array_to_string(" + lines(*[f"CASE WHEN {no} bool_or(country = '{c}') THEN '{c}' END" for c in _four]) + ", ',')"
twin("country_rollup", f"""
SELECT product_id, count(*) AS total_reviews, {rounded('avg(rating)', 2)} AS average_rating, {_stars}, {_listed('')} AS successful_countries, {_listed('NOT')} AS failed_countries
FROM mx WHERE country IN {words(_four)} GROUP BY product_id""", "mx")
twin("country_ratings", f"SELECT product_id, country, count(*) AS total_reviews, avg(rating) AS average_rating, {_stars} FROM mx GROUP BY ALL", "mx")
_texts = lambda line, n: f"""SELECT product_id, string_agg({line}, {NL} ORDER BY seq) AS review_texts FROM (
  SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) <= {n}) GROUP BY product_id"""
_cut_text = lambda n: f"left(body, {n}) || '...'"
_rated = "'- Rating ' || rating::VARCHAR || '/5: ' || " + _cut_text(100)
twin("review_context", f"""
SELECT product_id, count(*) AS total_reviews, {fixed('avg(rating)')} AS average_rating, {_counts}, any_value(review_texts) AS review_texts
FROM sl JOIN ({_texts(_rated, 10)}) USING (product_id) GROUP BY product_id""", "sl")
_short = "'- ' || " + _cut_text(80)
twin("review_context_short", _texts(_short, 5), "sl")

# ------------------------------------------------------------------ growth
_buy = lambda r: f"sum(floor(review_count::DOUBLE / {r}::DOUBLE)::BIGINT)::BIGINT"
twin("estimate_buyers", f"SELECT product_id, {_buy(0.02)} AS estimated_buyers, {_buy(0.03)} AS buyers_low, {_buy(0.01)} AS buyers_high FROM sn GROUP BY 1", "sn")
_step = "strftime(step_ts, '%Y-%m-%d %H:%M') AS step_ts"
for _period in ("day", "week", "month", "quarter"):
    twin(f"growth_series_{_period}", f"SELECT product_id, {_step}, date, buyers, rating, trend FROM gs_{_period}", f"gs_{_period}")
twin("growth_points", "SELECT product_id, date, buyers, rating FROM gp_month", "gp_month")
twin("growth_trend", f"SELECT product_id, {_step}, buyers, coalesce(previous, 0) AS previous_buyers, trend FROM gs_month", "gs_month")
part("gm", ["sn", "gm_week", "gm_month"], """
SELECT * FROM (SELECT DISTINCT product_id FROM sn) LEFT JOIN gm_week USING (product_id) LEFT JOIN gm_month USING (product_id)""")
twin("growth_metrics", f"""
SELECT product_id, {rounded('week_growth', 1)} AS weekly_growth, {rounded('month_growth', 1)} AS monthly_growth, trunc(week_mean)::BIGINT AS weekly_average,
  trunc(month_mean)::BIGINT AS monthly_average, week_best AS best_day, week_peak AS peak_buyers,
  CASE WHEN week_growth > 5 THEN 'growing' WHEN week_growth < -5 THEN 'declining' WHEN week_growth IS NOT NULL THEN 'stable' END AS trend,
  {rounded('week_strength * 100', 1)} AS trend_strength,
  CASE WHEN week_last IS NULL OR month_last IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status FROM gm""", "gm")
twin("growth_forecast", """
SELECT product_id, trunc(week_last * (1 + week_growth / 100))::BIGINT AS next_week,
  CASE WHEN week_strength > 0.7 THEN 'high' WHEN week_strength > 0.4 THEN 'medium' WHEN week_growth IS NOT NULL THEN 'low' END AS confidence FROM gm""", "gm")
_gr = {k: text(v) for k, v in d.GROWTH_RECOMMENDATIONS.items()}
_advice = lines(
    f"CASE WHEN week_growth > 10 THEN {_gr['strong']} WHEN week_growth < -10 THEN {_gr['declining']} END",
    f"CASE WHEN week_strength > 0.7 THEN {_gr['consistent']} WHEN week_strength < 0.3 THEN {_gr['volatile']} END",
    f"CASE WHEN month_growth > 20 THEN {_gr['monthly']} END",
)
twin("growth_recommendations", f"SELECT product_id, array_to_string({_advice}, ' | ') AS recommendations FROM gm", "gm")
for _period, (_n, _days, _label) in {
    "day": (7, 1, "strftime(date, '%a')"), "week": (12, 7, "'Week ' || i"), "month": (6, 30, "strftime(date, '%b')"), "quarter": (4, 90, "'Q' || i"),
}.items():
    twin(f"period_labels_{_period}", f"""
SELECT product_id, i::INT AS position, date::VARCHAR AS date, {_label} AS label, buyers, {rounded('CASE WHEN base <> 0 THEN (buyers::DOUBLE / base - 1) * 100 ELSE 0::DOUBLE END', 1)} AS growth_rate
FROM (SELECT product_id, i, DATE '2024-01-31' - (({_n} - i) * {_days})::INT AS date, buyers, first(buyers) OVER (PARTITION BY product_id ORDER BY i) AS base
  FROM (SELECT product_id, {_n} - (DATE '2024-01-31' - ts::DATE) // {_days} AS i, trunc(sum(estimated_buyers)::DOUBLE / count(*))::BIGINT AS buyers FROM sn GROUP BY ALL)
  WHERE i BETWEEN 1 AND {_n})""", "sn")

# ------------------------------------------------------------------ samples, sets
_first = "row_number() OVER (PARTITION BY product_id, sentiment ORDER BY {})::INT AS sample_rank"
twin("review_samples", f"SELECT product_id, sentiment, {_first.format('seq')}, review_id, body FROM sl QUALIFY sample_rank <= 3", "sl")
_key = f"CASE sentiment WHEN 'positive' THEN -{rounded('compound', 3)} WHEN 'negative' THEN {rounded('compound', 3)} ELSE 0 END, seq"
twin("review_samples_best", f"SELECT product_id, sentiment, {_first.format(_key)}, review_id, compound FROM sl QUALIFY sample_rank <= 3", "sl")
twin("top_k_slices", """
SELECT product_id, 'keyword' AS kind, rank::INT AS rank, word AS entry FROM kr WHERE rank <= 8
UNION ALL SELECT product_id, 'theme', rank::INT, theme FROM tr WHERE rank <= 3""", "kr", "tr")
twin("union_countries", f"SELECT review_id, product_id, country FROM mx WHERE country IN {words(_four)}", "mx")


def _first_country(order, prefix: str) -> str:
    place = "CASE country " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(order)) + " END"
    return f"""SELECT review_id, product_id, {text(prefix)} || country AS country FROM mx WHERE {place} IS NOT NULL
QUALIFY {place} = min({place}) OVER (PARTITION BY product_id)"""


twin("first_available_country", _first_country(["IN", "US", "UK", "DE", "CA"], "") + " UNION ALL " + _first_country(["DE", "IN", "US", "UK", "CA"], "asked "), "mx")

# ------------------------------------------------------------------ insights
twin("insights_default", f"SELECT product_id, array_to_string({_default_lines}, ' | ') AS insights FROM an", "an")
_te, _ta = it.ENSEMBLE_TEXT, it.ENSEMBLE_ADVICE
part("an2", ["an"], f"SELECT *, CASE greatest({', '.join(f'h_{e}' for e in _default)}) {' '.join(f'WHEN h_{e} THEN {text(e)}' for e in _default)} END AS mood FROM an")
_theme_names = "list_transform(th, lambda t: t.theme)"
_pick3 = lambda a, b, c: f"CASE WHEN {SPOS} > 70 THEN {a} WHEN {SPOS} > 50 THEN {b} WHEN {SNEG} > 40 THEN {c} END"
_ens_lines = lines(
    _pick3(say(_te["exceptional"], fixed(SPOS)), say(_te["good"], fixed(SPOS)), say(_te["negative"], fixed(SNEG))),
    f"CASE WHEN {SNEU} > 30 THEN {say(_te['neutral'], fixed(SNEU))} END",
    f"CASE WHEN {_has_th} THEN {say(_te['themes'], f'array_to_string({_theme_names}[1:3], {text(chr(44) + chr(32))})')} END",
    f"CASE WHEN mood IN {words(it.BAD_MOODS)} THEN {say(_te['bad_mood'], 'mood')} WHEN mood IN {words(it.GOOD_MOODS)} THEN {say(_te['good_mood'], 'mood')} END",
    f"CASE WHEN avg_subjectivity > 0.6::DOUBLE THEN {text(_te['opinion'])} WHEN avg_subjectivity < 0.4::DOUBLE THEN {text(_te['facts'])} END",
    f"CASE WHEN {_has_kw} THEN {say(_te['keywords'], _kw(5))} END",
)
# none of the fixed theme names carries a trouble mark, so theme advice is empty here
_ens_advice = lines(
    _pick3(text(_ta["exceptional"]), text(_ta["good"]), text(_ta["negative"])),
    f"CASE WHEN {SNEU} > 30 THEN {text(_ta['neutral'])} END",
    f"CASE WHEN mood IN {words(it.BAD_MOODS)} THEN {text(_ta['bad_mood'])} WHEN mood IN {words(it.GOOD_MOODS)} THEN {text(_ta['good_mood'])} END",
    f"CASE WHEN avg_subjectivity > 0.6::DOUBLE THEN {text(_ta['opinion'])} WHEN avg_subjectivity < 0.4::DOUBLE THEN {text(_ta['facts'])} END",
)
twin("insights_ensemble", f"""
SELECT product_id, array_to_string({_ens_lines}, ' | ') AS insights, array_to_string({_ens_advice}, ' | ') AS recommendations,
  CASE WHEN {_all} > 50 THEN 'high' WHEN {_all} > 20 THEN 'medium' ELSE 'low' END AS confidence FROM an2""", "an2")
_tf = it.FREE_TEXT
_free_lines = lines(
    f"CASE WHEN {SPOS} > 70 THEN {say(_tf['positive'], fixed(SPOS))} WHEN {SPOS} > 50 THEN {say(_tf['good'], fixed(SPOS))} WHEN {SNEG} > 50 THEN {say(_tf['negative'], fixed(SNEG))} END",
    f"CASE WHEN {_has_th} THEN {say(_tf['theme'], 'th[1].theme', 'th[1].mentions')} END",
    f"CASE WHEN avg_subjectivity > 0.6::DOUBLE THEN {text(_tf['opinion'])} WHEN avg_subjectivity < 0.4::DOUBLE THEN {text(_tf['facts'])} END",
)
twin("insights_free", f"""
SELECT product_id, array_to_string({_free_lines}, ' | ') AS insights, CASE WHEN avg_confidence > 0.6::DOUBLE THEN 'high' ELSE 'medium' END AS confidence FROM an""", "an")
_tb = it.FALLBACK_TEXT
_back_lines = lines(
    f"CASE WHEN {POS} > 70 THEN {say(_tb['excellent'], fixed(POS))} WHEN {POS} > 50 THEN {say(_tb['good'], fixed(POS))} ELSE {say(_tb['improve'], fixed(POS))} END",
    f"CASE WHEN {NEG} > 30 THEN {say(_tb['negative'], fixed(NEG))} END",
    f"CASE WHEN {_has_kw} THEN {say(_tb['keywords'], _kw(3))} END",
    f"CASE WHEN analyzed > 100 THEN {say(_tb['many'], 'analyzed')} WHEN analyzed < 20 THEN {say(_tb['few'], 'analyzed')} END",
    f"CASE WHEN average_rating >= 4.5 THEN {say(_tb['premium'], fixed('average_rating'))} WHEN average_rating >= 4 THEN {say(_tb['above'], fixed('average_rating'))} END",
)
twin("insights_fallback", f"SELECT product_id, array_to_string(({_back_lines})[1:5], ' | ') AS insights FROM an", "an")
_fraction = "(CASE WHEN analyzed = 0 THEN 0::DOUBLE ELSE positive::DOUBLE / analyzed::DOUBLE END * 100)"
_verdict = lambda i: f"CASE WHEN {_fraction} > 70 THEN {text(it.TEMPLATE_VERDICTS[0][i])} WHEN {_fraction} > 50 THEN {text(it.TEMPLATE_VERDICTS[1][i])} ELSE {text(it.TEMPLATE_VERDICTS[2][i])} END"
_template = say(("\n" + " " * 8).join(it.TEMPLATE_LINES), "analyzed", _verdict(1), fixed(_fraction), _verdict(2), _verdict(3))
_template_key = " || ' | ' || ".join([say(it.TEMPLATE_INSIGHTS[0], fixed(_fraction)), say(it.TEMPLATE_INSIGHTS[1], _verdict(3)), text(it.TEMPLATE_INSIGHTS[2])])
twin("insights_template", f"SELECT product_id, {_template} AS text, {_template_key} AS key_insights, {text(' | '.join(it.TEMPLATE_ADVICE))} AS recommendations FROM an", "an")
part("ap", ["sl", "kl_api"], f"SELECT * FROM (SELECT product_id, count(*) AS total_reviews, avg(rating) AS average_rating, {_counts} FROM sl GROUP BY 1) LEFT JOIN kl_api USING (product_id)")
APOS, ANEG, ANEU = (pct(c, "total_reviews") for c in ("positive", "negative", "neutral"))
_grade = lambda o: f"CASE WHEN {APOS} > 70 THEN {text(o[0])} WHEN {APOS} > 40 THEN {text(o[1])} ELSE {text(o[2])} END"
_api_lines = " || ' | ' || ".join([say(it.API_TEXT[0], fixed(APOS)), say(it.API_TEXT[1], "negative"), say(it.API_TEXT[2], "coalesce(kw[1], 'N/A')")])
twin("insights_api", f"SELECT product_id, {say(it.API_VERDICT, _grade(('strong', 'moderate', 'weak')))} AS summary, {_api_lines} AS insights FROM ap", "ap")
_answer_line = """CASE (i - 1) % 7 WHEN 0 THEN '- ' || l WHEN 1 THEN '  2. You SHOULD note ' || l WHEN 2 THEN '🎯 ' || l WHEN 3 THEN '# ' || l ELSE l END"""
part("al", [], f"""
SELECT doc_id, i, {strip('line')} AS line FROM (SELECT doc_id, i, {_answer_line} AS line FROM
  (SELECT doc_id, unnest(w) AS l, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, {NL}) AS w FROM documents)))""")
_take = lambda expr, cond, n: f"""(SELECT doc_id, string_agg(x, ' | ' ORDER BY i) AS v FROM (SELECT doc_id, i, {expr} AS x FROM al WHERE {cond}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= {n}) GROUP BY doc_id)"""
_bullet = strip(f"ltrim(line, {text(it.BULLET_MARKS)})")
_told = "upper(left(line, 1)) || lower(substr(line, 2))"
twin("parse_model_bullets", f"""
SELECT doc_id, coalesce(b.v, '') AS bullets, coalesce(k.v, '') AS key_lines, coalesce(r.v, {text(it.PARSE_DEFAULT_ADVICE)}) AS recommendations
FROM (SELECT doc_id FROM documents)
LEFT JOIN {_take(_bullet, f"regexp_matches(line, '{it.BULLET_PATTERN}')", 5)} b USING (doc_id)
LEFT JOIN {_take('line', "length(line) > 20 AND NOT starts_with(line, '#')", 3)} k USING (doc_id)
LEFT JOIN {_take(_told, any_of('lower(line)', it.ADVICE_WORDS), 3)} r USING (doc_id)""", "al")

# ------------------------------------------------------------------ summaries
twin("summaries_default", f"SELECT product_id, {_none(0, _overall)} AS overall, {_none(1, _praise)} AS positive_highlights, {_none(2, _blame)} AS negative_highlights FROM an", "an")
_aw = f"CASE WHEN {_has_kw} THEN kw[1:5] ELSE {array(sm.API_WORDS)} END"
_word = lambda i, default: f"coalesce(({_aw})[{i + 1}], {text(default)})"
_api_overall = say(sm.API_OVERALL, "total_reviews", _grade(sm.API_GRADES), fixed(APOS), fixed(ANEU), fixed(ANEG), _grade(sm.API_REMARKS), f"array_to_string(({_aw})[1:3], ', ')")
_api_praise = say(sm.API_PRAISE, fixed(APOS), *[_word(i, w) for i, w in enumerate(sm.API_DEFAULT_PRAISE)])
_api_blame = say(sm.API_BLAME, fixed(ANEG), *[_word(i, w) for i, w in enumerate(sm.API_DEFAULT_BLAME)])
twin("summaries_api", f"SELECT product_id, {_api_overall} AS overall, {_api_praise} AS positive_highlights, {_api_blame} AS negative_highlights FROM ap", "ap")
_se = sm.ENSEMBLE_TEXT
twin("summary_ensemble", f"""
SELECT product_id, CASE WHEN analyzed = 0 THEN {text(_se['empty'])} ELSE {say(_se['start'], 'analyzed')} ||
  CASE WHEN {POS} > 60 THEN {text(_se['high'])} WHEN {POS} > 40 THEN {text(_se['middle'])} ELSE {text(_se['low'])} END ||
  CASE WHEN {_has_th} THEN {say(_se['theme'], 'lower(th[1].theme)')} ELSE '' END END AS summary FROM an""", "an")
_sf = sm.FREE_TEXT
twin("summary_free", f"""
SELECT product_id, {say(_sf['start'], 'analyzed')} || CASE WHEN {SPOS} > 60 THEN {text(_sf['high'])} WHEN {SNEG} > 40 THEN {text(_sf['low'])} ELSE {text(_sf['middle'])} END AS summary FROM an""", "an")
_level = "CASE " + " ".join(f"WHEN {POS} >= {b} THEN {text(n)}" for b, n in sm.FALLBACK_GRADES) + f" ELSE {text(sm.FALLBACK_LOW)} END"
_market = f"CASE WHEN {POS} >= 70 THEN {text(sm.FALLBACK_MARKET[0])} ELSE {text(sm.FALLBACK_MARKET[1])} END"
twin("summary_fallback", f"SELECT product_id, {say(sm.FALLBACK_TEXT, 'analyzed', fixed('average_rating'), _level, 'positive', 'negative', _market)} AS summary FROM an", "an")
_mean_up = fixed_up("average_rating", 1)
twin("summary_dashboard", f"""
SELECT product_id, {say(sm.DASHBOARD_TEXT, 'total_reviews', fixed_up(SPOS, 0), fixed_up(SNEU, 0), fixed_up(SNEG, 0), _mean_up)} AS summary,
  {say(sm.SHARE_TEXT, text('Review report'), 'product_id', _mean_up, 'total_reviews', fixed_up(SPOS, 0))} AS share FROM an""", "an")

# ------------------------------------------------------------------ variants
part("ve", ["sl", "vv"], "SELECT product_id, polarity, subjectivity, vv.confidence, vv.sentiment FROM sl JOIN vv USING (review_id)")
_means = lambda source: ", ".join(f"{rounded(mean_nano(nano(source(c)), 'count(*)'), 3)} AS avg_{c}" for c in ("polarity", "subjectivity", "confidence"))
part("vd", ["ve", "ev", "tocc", "kl_ensemble"], f"""
SELECT *, CASE greatest({', '.join(_ens_n)}) {' '.join(f"WHEN {e} THEN '{e}'" for e in _ens_n)} END AS mood, positive AS pc, negative AS gc, total - positive - negative AS uc
FROM (SELECT product_id, count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
  {_means(lambda c: c)} FROM ve GROUP BY product_id)
JOIN ev USING (product_id) LEFT JOIN kl_ensemble USING (product_id)
LEFT JOIN (SELECT product_id, list({{'theme': theme, 'mentions': mentions}} ORDER BY ordinal) AS th FROM tocc GROUP BY 1) USING (product_id)""")
part("ve2", ["vd"], "SELECT * EXCLUDE (neutral), uc AS neutral, neutral AS neutral_share, total AS analyzed FROM vd")
twin("analysis_document_ensemble", f"""
SELECT product_id, analyzed, positive, neutral, negative, avg_polarity, avg_subjectivity, avg_confidence, joy, neutral_share, mood AS dominant_emotion,
  coalesce(array_to_string(list_transform(th, lambda t: t.theme || ':' || t.mentions), ','), '') AS themes, array_to_string(kw, ',') AS keywords,
  array_to_string({_ens_lines}, ' | ') AS insights, array_to_string({_ens_advice}, ' | ') AS recommendations,
  {say(_se['start'], 'analyzed')} || CASE WHEN {POS} > 60 THEN {text(_se['high'])} WHEN {POS} > 40 THEN {text(_se['middle'])} ELSE {text(_se['low'])} END ||
  CASE WHEN {_has_th} THEN {say(_se['theme'], 'lower(th[1].theme)')} ELSE '' END AS summary FROM ve2""", "ve2")
part("fd", ["sl_free", "tasp"], f"""
SELECT * FROM (SELECT product_id, count(*) AS analyzed, {_counts}, {_means(lambda c: rounded(c, 3))} FROM sl_free GROUP BY product_id)
LEFT JOIN (SELECT product_id, list({{'theme': theme, 'mentions': mentions, 'sentiment': sentiment}} ORDER BY rank) AS th FROM tasp GROUP BY 1) USING (product_id)""")
twin("analysis_document_free", f"""
SELECT product_id, analyzed, positive, neutral, negative, avg_polarity, avg_subjectivity, avg_confidence,
  array_to_string(list_transform(th, lambda t: t.theme || '/' || t.mentions || '/' || t.sentiment), ',') AS themes,
  array_to_string({_free_lines}, ' | ') AS insights, {say(_sf['start'], 'analyzed')} ||
  CASE WHEN {SPOS} > 60 THEN {text(_sf['high'])} WHEN {SNEG} > 40 THEN {text(_sf['low'])} ELSE {text(_sf['middle'])} END AS summary,
  CASE WHEN avg_confidence > 0.6::DOUBLE THEN 'high' ELSE 'medium' END AS confidence_level FROM fd""", "fd")
part("ape", ["eh_api"], "SELECT product_id, " + ", ".join(
    rounded(f"sum(round(least(h_{e} * 0.15::DOUBLE * {_weight}, 1::DOUBLE) * 1e9)::BIGINT)::BIGINT::DOUBLE / 1e9 / count(*)", 3) + f" AS {e}" for e in ("joy", "trust")
) + " FROM eh_api GROUP BY product_id")
twin("analysis_document_api", f"""
SELECT product_id, total_reviews, {rounded('average_rating', 2)} AS average_rating, s5 AS stars_5, s1 AS stars_1, positive, neutral, negative, joy, trust,
  coalesce(themes, '') AS themes, {say(it.API_VERDICT, _grade(('strong', 'moderate', 'weak')))} AS verdict, {_api_lines} AS insights, {_api_overall} AS overall
FROM ap JOIN ape USING (product_id)
JOIN (SELECT product_id, count(*) FILTER (WHERE rating = 5) AS s5, count(*) FILTER (WHERE rating = 1) AS s1 FROM rv GROUP BY 1) USING (product_id)
LEFT JOIN (SELECT product_id, string_agg(theme, ',' ORDER BY rank) AS themes FROM tl2 GROUP BY 1) USING (product_id)""", "ap", "ape", "tl2", "rv")

# ------------------------------------------------------------------ report
_rows = [
    ("ASIN", "product_id"), ("Product Title", "coalesce(product_title, 'N/A')"), ("Brand", "coalesce(brand, 'N/A')"), ("Total Reviews", "total_reviews"), ("Average Rating", "average_rating"),
    ("Country", "'US'"), ("Data Source", "'unknown'"), ("AI Provider", "'N/A'"), ("", "''"), ("Sentiment Analysis", "''"), ("Positive Reviews", "positive"),
    ("Neutral Reviews", "neutral"), ("Negative Reviews", "negative"), ("Positive %", f"{fixed(SPOS)} || '%'"), ("", "''"), ("Bot Detection", "''"),
    ("Total Reviews Analyzed", "total_reviews"), ("Genuine Reviews", "total_reviews - bot_count"), ("Bot Reviews Filtered", "bot_count"),
    ("Bot Percentage", "bot_percentage::VARCHAR || '%'"),
]
_summary_rows = " UNION ALL ".join(
    f"SELECT product_id, {i} AS ordinal, {text(m)} AS metric, ({v})::VARCHAR AS value FROM an LEFT JOIN prod USING (product_id)" + (f" WHERE {_all} > 0" if m == "Positive %" else "")
    for i, (m, v) in enumerate(_rows)
)
twin("report_summary_section", _summary_rows, "an", "prod")
twin("report_keywords", "SELECT product_id, rank::INT AS rank, word, frequency FROM kr_ok", "kr_ok")
twin("report_themes", "SELECT product_id, rank::INT AS rank, theme, mentions, sentiment FROM tr_ok", "tr_ok")
_insight_rows = f"SELECT product_id, unnest(l) AS insight, (generate_subscripts(l, 1) - 1)::INT AS position FROM (SELECT product_id, {_default_lines} AS l FROM an)"
twin("report_insights", _insight_rows, "an")
twin("report_rating_section", " UNION ALL ".join(f"SELECT product_id, '{s} Star' AS rating, stars_{s} AS count FROM rc" for s in STARS), "rc")
twin("report_reviews_section", """
SELECT product_id, title, body AS text, rating, author, review_date AS date, sentiment, verified, bot_score FROM sl
JOIN (SELECT review_id, tenths / 10.0::DOUBLE AS bot_score FROM bs) USING (review_id)""", "sl", "bs")
_pdf = [f"SELECT product_id, 'sentiment' AS section, '{x.title()}' AS name, {x} || ' ' || {fixed(pct(x, 'total_reviews'))} || '%' AS value FROM an" for x in LABELS]
_pdf += [f"SELECT product_id, 'bots', {text(m)}, ({v})::VARCHAR FROM an WHERE bot_count > 0" for m, v in _rows[16:]]
_pdf += ["SELECT product_id, 'themes', theme, mentions || ' ' || upper(sentiment[1]) || sentiment[2:] FROM tr_ok"]
_pdf += [f"SELECT product_id, 'ratings', '{s} Star', stars_{s}::VARCHAR FROM an" for s in STARS]
_pdf += ["SELECT product_id, 'keywords', word, rank || ' ' || frequency FROM kr_ok WHERE rank <= 15", f"SELECT product_id, 'insights', position::VARCHAR, insight FROM ({_insight_rows})"]
twin("report_pdf_sections", " UNION ALL ".join(_pdf), "an", "tr_ok", "kr_ok")
_star_rows = " UNION ALL ".join(f"SELECT product_id, '{s} Star' AS rating, stars_{s} AS count FROM an" for s in STARS)
_read_back = [
    ("summary", "metric || ':' || coalesce(value, '')", "ordinal", _summary_rows), ("keywords", "word || ':' || frequency", "rank", "SELECT * FROM kr_ok"),
    ("themes", "theme || ':' || mentions || ':' || sentiment", "rank", "SELECT * FROM tr_ok"), ("insights", "insight", "position", _insight_rows),
    ("ratings", "rating || ':' || count", "rating", _star_rows),
]
twin("write_report", " UNION ALL ".join(
    f"SELECT product_id, '{section}' AS section, count(*) AS n, md5(string_agg({line}, '|' ORDER BY {order})) AS digest FROM ({rows}) GROUP BY product_id"
    for section, line, order, rows in _read_back
) + " UNION ALL SELECT product_id, 'reviews', count(*), md5('') FROM rv GROUP BY product_id", "an", "prod", "kr_ok", "tr_ok")

# ------------------------------------------------------------------ streams
# a day is closed once the latest snapshot is a day past its end
twin("stream_growth_days", f"""
SELECT product_id, ts::DATE::VARCHAR AS date, count(*) AS snapshots, sum(estimated_buyers)::DOUBLE / count(*) AS mean_buyers,
  {rounded('sum(rating::DECIMAL(18, 6))::DOUBLE / count(*)', 4)} AS mean_rating
FROM sn WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM sn) - INTERVAL 1 DAY GROUP BY ALL""", "sn")
twin("stream_scored_reviews", """
SELECT review_id, tenths / 10.0::DOUBLE AS bot_score, compound, sentiment, joy, sadness, neutral FROM (SELECT review_id, tenths FROM bs)
JOIN (SELECT review_id, compound, sentiment FROM sl) USING (review_id) JOIN (SELECT review_id, joy, sadness, neutral FROM er) USING (review_id)""",
     "bs", "sl", "er")
twin("stream_bulk_posting_days", """
SELECT product_id, day::VARCHAR AS date, count(*) AS reviews, min(rating) AS rating FROM (SELECT product_id, rating, substr(review_date, 1, 10)::DATE AS day FROM rv)
WHERE day + INTERVAL 1 DAY <= (SELECT max(substr(review_date, 1, 10)::TIMESTAMP) FROM rv) - INTERVAL 1 DAY
GROUP BY ALL HAVING count(*) >= 5 AND min(rating) = max(rating)""", "rv")
twin("stream_growth_all_days", f"""
SELECT product_id, ts::DATE::VARCHAR AS date, count(*) AS snapshots, sum(estimated_buyers)::DOUBLE / count(*) AS mean_buyers,
  {rounded('sum(rating::DECIMAL(18, 6))::DOUBLE / count(*)', 4)} AS mean_rating
FROM sn GROUP BY ALL""", "sn")
twin("stream_bulk_posting_all", """
SELECT product_id, day, count(*) AS reviews, min(rating) AS rating FROM (SELECT product_id, rating, CASE WHEN seq % 7 = 0 THEN '' ELSE split_part(review_date, 'T', 1) END AS day FROM rv)
GROUP BY ALL HAVING count(*) >= 5 AND min(rating) = max(rating)""", "rv")
