"""Queries over names, texts and bytes: domain analytics, personal data, hashes, fingerprints, shares and pipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirespark.dims import ADMIN_SHARES, BIGRAMS, COMMON_TLDS, DNS_RCODES, DNS_TYPES, EXTENSIONS, PII_DEFAULT, PII_PATTERNS, REMOTE_EXEC_TOOLS, SECRET_PATTERNS, SERVICE_PIPES, SUSPICIOUS_CONTENT, WMI_PIPES, sql_case, sql_list
from wirespark.functions import content, domain, encoding, fingerprint, pii
from wirespark.operators import traffic
from wirespark.plans.packets import SQL_PACKETS, packets
from wirespark.plans.registry import query

R = 6


def r(column, name):
    return F.round(F.col(column) if isinstance(column, str) else column, R).alias(name)


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


# ---- names: hosts of pages, and names made from hashes, so that every rule is met

_NAME = {
    "spark": "CASE page_id % 5 WHEN 0 THEN host WHEN 1 THEN concat(substring(h, 1, 30), '.t.example.com') WHEN 2 THEN concat(substring(h, 1, 12), '.com') "
    "WHEN 3 THEN concat(replace(host, '.', '-'), '.', host) ELSE concat('a.b.c.', substring(h, 1, 24), '.in-addr.arpa.') END",
}
NAMES = f"""WITH n0 AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, md5(CAST(page_id AS VARCHAR)) AS h FROM pages),
    names AS (SELECT page_id, {_NAME['spark']} AS name FROM n0), labels AS (SELECT *, string_split(CASE WHEN ends_with(name, '.') THEN name[:-2] ELSE name END, '.') AS x FROM names)"""


def names(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    p = p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.md5(F.encode(F.col("page_id").cast("string"), "utf-8")).alias("h"))
    return p.select("page_id", F.expr(_NAME["spark"]).alias("name"))


def sql_entropy(s: str, of: str = "strlen") -> str:
    p = f"((length({s}) - length(replace({s}, c, ''))) / CAST({of}({s}) AS DOUBLE))"
    return f"(CASE WHEN length({s}) > 0 THEN -list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: {p} * log2({p}))) ELSE 0.0::DOUBLE END)"


def sql_share(s: str, cls: str, of: str | None = None) -> str:
    base = f"strlen({s})" if of is None else f"length(regexp_replace({s}, '[^{of}]', '', 'g'))"
    return f"coalesce(length(regexp_replace({s}, '[^{cls}]', '', 'g')) / nullif(CAST({base} AS DOUBLE), 0), 0)"


def sql_grams(s: str, n: int) -> str:
    return f"list_transform(range(1, length({s}) - {n} + 2), lambda i: substr({s}, CAST(i AS INT), {n}))"


def sql_gram_entropy(s: str, n: int) -> str:
    g = sql_grams(s, n)
    return f"(CASE WHEN length({s}) >= {n} THEN -list_sum(list_transform(list_distinct({g}), lambda t: (len(list_filter({g}, lambda u: u = t)) / CAST(length({s}) - {n} + 1 AS DOUBLE)) * log2(len(list_filter({g}, lambda u: u = t)) / CAST(length({s}) - {n} + 1 AS DOUBLE)))) ELSE 0.0::DOUBLE END)"


_CONS = "b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z"


@query("fn_split_domain", f"{NAMES} SELECT page_id, len(x) AS n, x[1] AS first, x[-1] AS last FROM labels")
def _(spark, d):
    x = domain.labels("name")
    return names(spark, d).select("page_id", F.size(x).cast("long").alias("n"), F.element_at(x, 1).alias("first"), F.element_at(x, -1).alias("last"))


@query("fn_join_labels", f"{NAMES} SELECT page_id, array_to_string(x[:-3], '.') AS joined FROM labels")
def _(spark, d):
    x = domain.labels("name")
    return names(spark, d).select("page_id", F.array_join(F.slice(x, 1, F.greatest(F.size(x) - 2, F.lit(0))), ".").alias("joined"))


@query("fn_entropy_str", f"{NAMES} SELECT page_id, round({sql_entropy('name')}, {R}) AS entropy FROM names")
def _(spark, d):
    return names(spark, d).select("page_id", r(domain.entropy("name"), "entropy"))


@query("fn_entropy_ngram", f"{NAMES} SELECT page_id, round({sql_gram_entropy('name', 2)}, {R}) AS two, round({sql_gram_entropy('name', 3)}, {R}) AS three FROM names")
def _(spark, d):
    return names(spark, d).select("page_id", r(domain.ngram_entropy("name", 2), "two"), r(domain.ngram_entropy("name", 3), "three"))


@query("fn_consonant_ratio", f"{NAMES} SELECT page_id, round({sql_share('name', _CONS, 'a-zA-Z')}, {R}) AS ratio FROM names")
def _(spark, d):
    return names(spark, d).select("page_id", r(domain.consonant_ratio("name"), "ratio"))


_BIGRAM = f"CASE WHEN length({{s}}) >= 2 THEN len(list_filter({sql_grams('lower({s})', 2)}, lambda t: t IN {sql_list(BIGRAMS)})) / CAST(length({{s}}) - 1 AS DOUBLE) ELSE 0.0::DOUBLE END"


@query("fn_bigram_score", f"{NAMES} SELECT page_id, round({_BIGRAM.format(s='name')}, {R}) AS score FROM names")
def _(spark, d):
    return names(spark, d).select("page_id", r(domain.bigram_score("name"), "score"))


_B64 = "(strlen({s}) >= 20 AND " + sql_share("{s}", "A-Za-z0-9+/=") + " > 0.95::DOUBLE)"
_HEX = "(strlen({s}) >= 16 AND " + sql_share("{s}", "0-9a-fA-F") + " > 0.9::DOUBLE)"


@query("fn_base64_like", f"{NAMES} SELECT page_id, {_B64.format(s='x[1]')} AS hit FROM labels")
def _(spark, d):
    return names(spark, d).select("page_id", domain.base64_like(F.element_at(domain.labels("name"), 1)).alias("hit"))


@query("fn_hex_like", f"{NAMES} SELECT page_id, {_HEX.format(s='x[1]')} AS hit FROM labels")
def _(spark, d):
    return names(spark, d).select("page_id", domain.hex_like(F.element_at(domain.labels("name"), 1)).alias("hit"))


@query("fn_numeric_like", f"{NAMES} SELECT page_id, {sql_share('name', '0-9')} > 0.3::DOUBLE AS hit FROM names")
def _(spark, d):
    return names(spark, d).select("page_id", domain.numeric_like("name").alias("hit"))


@query("fn_reverse_dns", f"{NAMES} SELECT page_id, len(x) >= 2 AND x[-1] = 'arpa' AND x[-2] = 'in-addr' AS hit FROM labels")
def _(spark, d):
    return names(spark, d).select("page_id", domain.is_reverse("name").alias("hit"))


@query("fn_common_tld", f"{NAMES} SELECT page_id, x[-1] IN {sql_list(COMMON_TLDS)} AS hit FROM labels")
def _(spark, d):
    return names(spark, d).select("page_id", domain.is_common_tld(F.element_at(domain.labels("name"), -1)).alias("hit"))


@query("fn_dns_features", f"""{NAMES} SELECT page_id, strlen(name)::DOUBLE AS domain_length, len(x) - 1.0::DOUBLE AS subdomain_count, list_max(list_transform(x, lambda l: strlen(l)))::DOUBLE AS max_label_length,
    round(list_sum(list_transform(x, lambda l: strlen(l))) / CAST(len(x) AS DOUBLE), {R}) AS avg_label_length, round({sql_share('name', '0-9')}, {R}) AS numeric_ratio, round({sql_share('name', 'a-zA-Z')}, {R}) AS alpha_ratio,
    round(length(regexp_replace(name, '[0-9a-zA-Z.]', '', 'g')) / CAST(strlen(name) AS DOUBLE), {R}) AS special_ratio, round({sql_share('name', _CONS)}, {R}) AS consonant_ratio, round({sql_share('name', 'aeiouAEIOU')}, {R}) AS vowel_ratio,
    round({sql_entropy('name')}, {R}) AS domain_entropy, round(list_sum(list_transform(x, lambda l: {sql_entropy('l')})) / len(x), {R}) AS label_entropy, round({sql_gram_entropy('name', 2)}, {R}) AS bigram_entropy,
    round({sql_gram_entropy('name', 3)}, {R}) AS trigram_entropy, round(1 / 255.0::DOUBLE, {R}) AS query_type, (len(x) >= 2 AND x[-1] = 'arpa' AND x[-2] = 'in-addr')::INT::DOUBLE AS is_reverse_lookup,
    regexp_matches(name, '[0-9]')::INT::DOUBLE AS has_digits, contains(name, '-')::INT::DOUBLE AS has_hyphens, strlen(x[-1])::DOUBLE AS tld_length, (x[-1] IN {sql_list(COMMON_TLDS)})::INT::DOUBLE AS is_common_tld FROM labels""")
def _(spark, d):
    return names(spark, d).select("page_id", *(r(c, n) for n, c in domain.features("name").items()))


def _when(test: str, points: str) -> str:
    return f"(CASE WHEN {test} THEN {points}::DOUBLE ELSE 0.0::DOUBLE END)"


_SUB = "array_to_string(x[:-3], '.')"
_TSCORE = f"least(0.0::DOUBLE + {_when(sql_entropy('sub') + ' > 3.5', '0.4')} + {_when('strlen(sub) > 50', '0.3')} + {_when('len(x) > 5', '0.2')} + {_when(_B64.format(s='sub'), '0.3')} + {_when(_HEX.format(s='sub'), '0.2')}, 1.0::DOUBLE)"
_GSCORE = f"least(0.0::DOUBLE + {_when(sql_entropy('sld') + ' > 3.8', '0.35')} + {_when(sql_share('sld', _CONS, 'a-zA-Z') + ' > 0.7::DOUBLE', '0.25')} + {_when(_BIGRAM.format(s='sld') + ' < 0.3::DOUBLE', '0.25')} + {_when(sql_share('sld', '0-9') + ' > 0.3::DOUBLE', '0.15')} + {_when('strlen(sld) < 4 OR strlen(sld) > 20', '0.1')}, 1.0::DOUBLE)"
SCORED = f"""{NAMES}, s0 AS (SELECT *, {_SUB} AS sub, coalesce(x[-2], '') AS sld FROM labels), s1 AS (SELECT *, {_TSCORE} AS ts, {_GSCORE} AS gs FROM s0),
    scored AS (SELECT *, len(x) >= 3 AND ts > 0.6::DOUBLE AS is_tunnelling, CASE WHEN len(x) < 3 THEN 0.1::DOUBLE ELSE ts END AS tscore,
    CASE WHEN len(x) < 3 THEN 'benign' WHEN {_HEX.format(s='sub')} THEN 'hex_encoding' WHEN {_B64.format(s='sub')} THEN 'base64_encoding' WHEN ts > 0.6::DOUBLE THEN 'dns_tunneling' ELSE 'benign' END AS kind,
    len(x) >= 2 AND gs > 0.6::DOUBLE AS is_dga, CASE WHEN len(x) < 2 THEN 0.1::DOUBLE ELSE gs END AS gscore FROM s1)"""


@query("fn_tunnel", f"{SCORED} SELECT page_id, is_tunnelling, round(tscore, {R}) AS score, kind AS threat_type FROM scored")
def _(spark, d):
    return names(spark, d).withColumn("t", domain.tunnelling("name")).select("page_id", "t.is_tunnelling", r("t.score", "score"), "t.threat_type")


@query("fn_dga", f"{SCORED} SELECT page_id, is_dga, round(gscore, {R}) AS score FROM scored")
def _(spark, d):
    return names(spark, d).withColumn("t", domain.generated("name")).select("page_id", "t.is_dga", r("t.score", "score"))


@query("fn_dns_analyze", f"{SCORED} SELECT page_id, CASE WHEN is_tunnelling THEN kind WHEN is_dga THEN 'dga' ELSE 'benign' END AS threat_type, round(CASE WHEN is_tunnelling THEN tscore WHEN is_dga THEN gscore ELSE 1.0::DOUBLE - greatest(tscore, gscore) END, {R}) AS confidence FROM scored")
def _(spark, d):
    return names(spark, d).withColumn("t", domain.analysed("name")).select("page_id", "t.threat_type", r("t.confidence", "confidence"))


@query("agg_dns_stats", f"{SCORED} SELECT count(*) AS queries, count(*) FILTER (is_tunnelling) AS tunnelling, count(*) FILTER (is_dga) AS dga FROM scored")
def _(spark, d):
    t = names(spark, d).withColumn("t", domain.analysed("name"))
    return t.agg(F.count("*").alias("queries"), F.count_if("t.is_tunnelling").alias("tunnelling"), F.count_if("t.is_dga").alias("dga"))


_FOLD = f"""{NAMES}, f0 AS (SELECT page_id, name, lower(name) AS low, string_split(name, '.') AS y FROM names), f1 AS (SELECT *, nullif(length(replace(low, '.', ''))::DOUBLE, 0) AS size, length(regexp_replace(low, '[^a-z]', '', 'g')) AS alpha,
    length(regexp_replace(low, '[^aeiou]', '', 'g')) AS vowels, length(regexp_replace(low, '[^0-9]', '', 'g')) AS digits, {sql_entropy('low', 'length')} AS entropy FROM f0),
    f AS (SELECT *, coalesce(digits / size, 0) AS digit_ratio, vowels / (alpha - vowels + 1.0::DOUBLE) AS vowel_ratio FROM f1)"""


@query("fn_dns_features_py", f"""{_FOLD} SELECT page_id, length(name)::DOUBLE AS length, len(y)::DOUBLE AS label_count, list_max(list_transform(y, lambda l: length(l)))::DOUBLE AS max_label, round(list_sum(list_transform(y, lambda l: length(l))) / CAST(len(y) AS DOUBLE), {R}) AS avg_label,
    round(alpha / size, {R}) AS alpha_ratio, round(digit_ratio, {R}) AS digit_ratio, round(length(regexp_replace(low, '[0-9a-z.]', '', 'g')) / size, {R}) AS special_ratio, round(entropy, {R}) AS entropy, round(vowel_ratio, {R}) AS vowel_ratio,
    round({sql_gram_entropy('low', 2)}, {R}) AS bigram_entropy, round({sql_gram_entropy('low', 3)}, {R}) AS trigram_entropy FROM f""")
def _(spark, d):
    return names(spark, d).select("page_id", *(r(c, n) for n, c in domain.features_folded("name").items()))


@query("fn_tunnel_py", f"""{_FOLD}, s AS (SELECT *, {_when('entropy > 3.5', '0.3')} + {_when('length(name) > 50', '0.2')} + {_when('len(y) > 4', '0.2')} + {_when('digit_ratio > 0.3::DOUBLE', '0.15')} + {_when('vowel_ratio < 0.1::DOUBLE', '0.15')} AS score FROM f)
    SELECT page_id, score > 0.5 AS is_tunnelling, round(least(score, 1.0), {R}) AS score, CASE WHEN score > 0.5 AND entropy > 4 AND digit_ratio > 0.4::DOUBLE THEN 'dns_tunneling_encoded' WHEN score > 0.5 AND len(y) > 6 THEN 'dns_tunneling_exfiltration' WHEN score > 0.5 THEN 'dns_tunneling_suspicious' ELSE 'benign' END AS threat_type FROM s""")
def _(spark, d):
    return names(spark, d).withColumn("t", domain.tunnelling_folded("name")).select("page_id", "t.is_tunnelling", r("t.score", "score"), "t.threat_type")


_OFF = " + ".join(f"abs(length(regexp_replace(part, '[^{c}]', '', 'g')) / total - {v}::DOUBLE)" for c, v in domain.LETTER_SHARES.items())


@query("fn_dga_py", f"""{NAMES}, g0 AS (SELECT page_id, string_split(lower(name), '.') AS y FROM names), g1 AS (SELECT page_id, CASE WHEN len(y) > 1 THEN array_to_string(y[:-2], '.') ELSE y[1] END AS part FROM g0),
    g2 AS (SELECT *, nullif(length(regexp_replace(part, '[^a-z]', '', 'g'))::DOUBLE, 0) AS total FROM g1),
    g3 AS (SELECT *, {_when('length(part) > 20', '0.15')} + {_when('coalesce(' + _OFF + ' > 0.5, FALSE)', '0.25')} + {_when(sql_entropy('part', 'length') + ' > 3.8', '0.2')} + {_when("coalesce(list_max(list_transform(regexp_extract_all(part, '[b-df-hj-np-tv-z]+'), lambda t: length(t))), 0) > 4", '0.2')}
        + {_when("length(regexp_replace(part, '[^0-9]', '', 'g')) > 3", '0.1')} + {_when("NOT regexp_matches(part, '[aeiou]') AND length(part) > 5", '0.1')} AS score FROM g2) SELECT page_id, score > 0.5 AS is_dga, round(least(score, 1.0), {R}) AS score FROM g3""")
def _(spark, d):
    return names(spark, d).withColumn("t", domain.generated_folded("name")).select("page_id", "t.is_dga", r("t.score", "score"))


@query("fn_dns_type", f"SELECT event_id, {sql_case('CAST(event_id % 300 AS INT)', DNS_TYPES, chr(39) + 'TYPE' + chr(39) + ' || (event_id % 300)')} AS type, {sql_case('CAST(event_id % 12 AS INT)', DNS_RCODES, chr(39) + 'RCODE' + chr(39) + ' || (event_id % 12)')} AS rcode FROM events")
def _(spark, d):
    from wirespark.dims import mapped

    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 300).cast("int").alias("t"), (F.col("event_id") % 12).cast("int").alias("c"))
    name = lambda c, table, head: mapped(F.col(c), table, F.concat(F.lit(head), F.col(c).cast("string")))
    return e.select("event_id", name("t", DNS_TYPES, "TYPE").alias("type"), name("c", DNS_RCODES, "RCODE").alias("rcode"))


# ---- personal data and secrets


def _sql_found(kinds, patterns) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(text, '{patterns[k].replace(chr(39), chr(39) * 2)}', 0)) AS value FROM documents" for k in kinds)


_LUHN = """(length({v}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({v})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({v}), CAST(i + 1 AS INT), 1) AS INT)
    WHEN CAST(substr(reverse({v}), CAST(i + 1 AS INT), 1) AS INT) > 4 THEN CAST(substr(reverse({v}), CAST(i + 1 AS INT), 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse({v}), CAST(i + 1 AS INT), 1) AS INT) * 2 END)) % 10 = 0)"""
_SURE = f"""CASE type WHEN 'email' THEN CASE WHEN contains(value, '@gmail.') OR contains(value, '@yahoo.') OR contains(value, '@outlook.') THEN 0.95 ELSE 0.85 END
    WHEN 'ssn' THEN CASE WHEN regexp_replace(value, '[- ]', '', 'g') = '000000000' THEN 0.1 ELSE 0.9 END WHEN 'credit_card' THEN CASE WHEN {_LUHN.format(v='value')} THEN 0.95 ELSE 0.5 END
    WHEN 'jwt' THEN 0.99 WHEN 'api_key' THEN CASE WHEN strlen(value) >= 32 THEN 0.9 ELSE 0.7 END ELSE 0.8 END::DOUBLE"""
PII = f"WITH f AS ({_sql_found(PII_DEFAULT, PII_PATTERNS)}), m AS (SELECT *, {_SURE} AS confidence FROM f)"


def found(spark, d, kinds=PII_DEFAULT):
    return pii.matches(docs(spark, d).select("doc_id", "text"), "text", kinds)


@query("pii_detect", f"{PII} SELECT doc_id, type, value, confidence FROM m WHERE confidence >= 0.7::DOUBLE")
def _(spark, d):
    return found(spark, d)


@query("pii_confidence", f"{PII} SELECT type, confidence, count(*) AS n FROM m GROUP BY ALL")
def _(spark, d):
    return pii.matches(docs(spark, d).select("doc_id", "text"), "text", least=0.0).groupBy("type", "confidence").agg(F.count("*").alias("n"))


@query("flt_pii_conf", f"{PII} SELECT doc_id, type, value FROM m WHERE confidence >= 0.9::DOUBLE AND NOT regexp_matches(value, 'example')")
def _(spark, d):
    return pii.matches(docs(spark, d).select("doc_id", "text"), "text", least=0.9, whitelist=["example"]).select("doc_id", "type", "value")


@query("pii_network", f"WITH f AS ({_sql_found(['ip_address', 'mac_address'], PII_PATTERNS)}) SELECT doc_id, type, value FROM f")
def _(spark, d):
    return found(spark, d, ["ip_address", "mac_address"]).select("doc_id", "type", "value")


_MASK = "CASE WHEN strlen(value) <= 4 THEN repeat('*', length(value)) ELSE concat(left(value, 1), repeat('*', length(value) - 2), right(value, 1)) END"


@query("pii_redact_value", f"{PII} SELECT doc_id, {_MASK} AS mask, concat('[SHA256:', left(sha256(value), 16), ']') AS hash, concat('[', upper(type), ']') AS label, '' AS removed FROM m WHERE confidence >= 0.7::DOUBLE")
def _(spark, d):
    k, v = F.col("type"), F.col("value")
    return found(spark, d).select("doc_id", *(pii.redacted_value(k, v, mode).alias(name) for mode, name in (("mask", "mask"), ("hash", "hash"), ("label", "label"), ("remove", "removed"))))


@query("pii_redact_text")
def _(spark, d):
    return docs(spark, d).select("doc_id", pii.redacted_text(F.col("text")).alias("text"))


@query("pii_secrets", f"WITH f AS ({_sql_found(SECRET_PATTERNS, SECRET_PATTERNS)}) SELECT doc_id, type, value, 0.95::DOUBLE AS confidence FROM f")
def _(spark, d):
    return pii.secrets(docs(spark, d).select("doc_id", "text"), "text")


@query("pii_conversations", "SELECT conv_id, turn, len(regexp_extract_all(text, '" + PII_PATTERNS["email"] + "')) AS emails FROM conversations")
def _(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", F.size(pii.found(F.col("text"), "email")).cast("long").alias("emails"))


@query("agg_pii_findings", f"{PII}, k AS (SELECT doc_id, type, count(*) AS n FROM m WHERE confidence >= 0.7::DOUBLE GROUP BY ALL) SELECT doc_id, type, n FROM k ORDER BY doc_id DESC, type LIMIT 10000")
def _(spark, d):
    return found(spark, d).groupBy("doc_id", "type").agg(F.count("*").alias("n")).orderBy(F.desc("doc_id"), "type").limit(10_000)


@query("pii_headers", "SELECT page_id, '[REDACTED]' AS cookie, concat('to ', '[EMAIL]') AS note FROM pages")
def _(spark, d):
    h = F.create_map(F.lit("Cookie"), F.col("url"), F.lit("X-Note"), F.concat(F.lit("to a"), F.col("page_id").cast("string"), F.lit("@b.org")))
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", pii.redacted_headers(h).alias("h"))
    return p.select("page_id", F.col("h")["Cookie"].alias("cookie"), F.col("h")["X-Note"].alias("note"))


_UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12), '.example.com')"


@query("pii_dns", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '[UUID].example.com' ELSE concat('[EMAIL]') END AS name FROM pages")
def _(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(F.encode("url", "utf-8")).alias("h"))
    name = F.when(F.col("page_id") % 2 == 0, F.expr(_UUID)).otherwise(F.concat(F.lit("user"), F.col("page_id").cast("string"), F.lit("@mail.example.com")))
    return p.select("page_id", pii.redacted_dns(name).alias("name"))


@query("pii_text_ct", "SELECT event_id, event_id % 4 IN (0, 1) AS is_text FROM events")
def _(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Text/Html; charset=x", "application/json", "image/png", "video/mp4"))), (F.col("event_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", pii.is_text_content(kind).alias("is_text"))


@query("fn_luhn", f"WITH n AS (SELECT event_id, CAST(4000000000000000 + event_id * 7919 AS VARCHAR) AS v FROM events) SELECT event_id, {_LUHN.format(v='v')} AS valid FROM n")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.lit(4000000000000000) + F.col("event_id") * 7919).cast("string").alias("v"))
    return e.select("event_id", pii.luhn_valid(F.col("v")).alias("valid"))


# ---- hashes, vectors


@query("fn_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def _(spark, d):
    b = F.encode("text", "utf-8")
    return docs(spark, d).select("doc_id", F.sha2(b, 256).alias("sha256"), F.md5(b).alias("md5"), F.sha1(b).alias("sha1"))


@query("fn_tsa_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", encoding.timestamp_digest(F.encode("text", "utf-8"), 256).alias("sha256"))


@query("fn_tsa_verify", "SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def _(spark, d):
    x = docs(spark, d).select("doc_id", F.encode("text", "utf-8").alias("b"))
    stored = F.when(F.col("doc_id") % 2 == 0, F.sha2("b", 256)).otherwise(F.lit("0"))
    return x.select("doc_id", encoding.digest_matches(F.col("b"), stored, 256).alias("valid"))


@query("jn_timestamp_evid", "SELECT a.doc_id, sha256(a.text) = sha256(b.text) AS valid FROM documents a JOIN documents b ON a.doc_id = b.doc_id")
def _(spark, d):
    x = docs(spark, d).select("doc_id", F.encode("text", "utf-8").alias("b"))
    stamps = x.select("doc_id", F.sha2("b", 256).alias("stamp"))
    return x.join(stamps, "doc_id").select("doc_id", encoding.digest_matches(F.col("b"), F.col("stamp"), 256).alias("valid"))


@query("fn_blake3")
def _(spark, d):
    return docs(spark, d).select("doc_id", encoding.blake3_hex(F.encode(F.col("text"), "utf-8")).alias("blake3"))


@query("fn_merkle")
def _(spark, d):
    return docs(spark, d).select("doc_id", encoding.merkle_root(F.encode(F.col("text"), "utf-8"), 1024).alias("root"))


@query("fn_utf16", "SELECT page_id, url FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.decode(F.encode("url", "UTF-16LE"), "UTF-16LE").alias("url"))


V = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT *, list_min(e) AS lo, list_max(e) AS hi, list_avg(e) AS m FROM v)"


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


@query("fn_normalize", f"{V} SELECT vec_id, round((e[1] - lo) / (hi - lo), {R}) AS first, round((e[-1] - lo) / (hi - lo), {R}) AS last FROM s")
def _(spark, d):
    return vectors(spark, d).withColumn("n", encoding.min_max(F.col("e"))).select("vec_id", r(F.element_at("n", 1), "first"), r(F.element_at("n", -1), "last"))


@query("fn_standardize", f"{V} SELECT vec_id, round((e[1] - m) / sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / len(e)), {R}) AS first FROM s")
def _(spark, d):
    return vectors(spark, d).withColumn("n", encoding.standardized(F.col("e"))).select("vec_id", r(F.get("n", F.lit(0)), "first"))


@query("fn_euclid", f"{V} SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), {R}) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    v = vectors(spark, d)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(other, "vec_id").select("vec_id", r(encoding.euclid(F.col("e"), F.col("f")), "distance"))


@query("fn_select_apply", f"{V} SELECT vec_id, round(e[1], {R}) AS a, round(e[4], {R}) AS b FROM v")
def _(spark, d):
    return vectors(spark, d).withColumn("n", encoding.selected(F.col("e"), [0, 3])).select("vec_id", r(F.col("n")[0], "a"), r(F.col("n")[1], "b"))


@query("fn_norm_apply", "WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), f AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM v) SELECT vec_id, round((x - m) / s, 5) AS x FROM v, f")
def _(spark, d):
    from wirespark.operators import series

    v = vectors(spark, d).select("vec_id", F.element_at("e", 1).alias("x"))
    return series.normalized(v, ["x"], series.fitted(v, ["x"])).select("vec_id", F.round("x", 5).alias("x"))


@query("fn_ifo_c", "SELECT event_id, round(CASE WHEN n <= 1 THEN 0 ELSE 2 * (ln(n - 1) + 0.5772156649015329::DOUBLE) - 2 * (n - 1) / CAST(n AS DOUBLE) END, 6) AS c FROM (SELECT event_id, event_id % 300 AS n FROM events)")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", r(encoding.average_path(F.col("event_id") % 300), "c"))


# ---- fingerprints: fields of hellos made from event numbers

_CH = "SELECT event_id, 771 + event_id % 2 AS v, [4865 + event_id % 3, 49195, 10 * 256 + 10, 156] AS c, [0, 23, 65281, 10, 16, 43] AS e, [29, 23 + event_id % 2] AS g, [0] AS p FROM events"


def hellos(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    n = F.col("event_id")
    arr = lambda *x: F.array(*(c if not isinstance(c, int) else F.lit(c).cast("long") for c in x))
    return e.select("event_id", (771 + n % 2).alias("v"), arr(4865 + n % 3, 49195, 2570, 156).alias("c"), arr(0, 23, 65281, 10, 16, 43).alias("e"), arr(F.lit(29).cast("long"), 23 + n % 2).alias("g"), arr(0).alias("p"))


_NOG = "list_filter(c, lambda x: x <> 2570)"


@query("fn_ja3", f"WITH h AS ({_CH}), j AS (SELECT event_id, concat_ws(',', v, array_to_string({_NOG}, '-'), array_to_string(e, '-'), array_to_string(g, '-'), array_to_string(p, '-')) AS ja3 FROM h) SELECT event_id, ja3, md5(ja3) AS hash FROM j")
def _(spark, d):
    return hellos(spark, d).select("event_id", fingerprint.ja3("v", "c", "e", "g", "p").alias("ja3")).withColumn("hash", F.md5(F.col("ja3").cast("binary")))


@query("fn_ja3s", "SELECT event_id, concat_ws(',', 771, 4865 + event_id % 3, '43-51') AS ja3s FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", fingerprint.ja3s(F.lit(771), 4865 + F.col("event_id") % 3, F.array(F.lit(43), F.lit(51))).alias("ja3s"))


@query("fn_ja4", f"""WITH h AS ({_CH}), x AS (SELECT event_id, {_NOG} AS c, e FROM h) SELECT event_id, concat('t13d', lpad(CAST(len(c) AS VARCHAR), 2, '0'), lpad(CAST(len(e) AS VARCHAR), 2, '0'), 'h2_',
    left(sha256(array_to_string(list_transform(list_sort(c), lambda x: lpad(lower(to_hex(x)), 4, '0')), ',')), 12), '_', left(sha256(array_to_string(list_transform(list_sort(list_filter(e, lambda x: x NOT IN (0, 16))), lambda x: lpad(lower(to_hex(x)), 4, '0')), ',')), 12)) AS ja4 FROM x""")
def _(spark, d):
    h = hellos(spark, d)
    return h.select("event_id", fingerprint.ja4("v", "c", "e", F.lit("host"), F.array(F.lit("h2")), F.array(F.lit(772), F.lit(771))).alias("ja4"))


@query("fn_ja4_q", f"""WITH h AS ({_CH}), x AS (SELECT event_id, {_NOG} AS c, e FROM h) SELECT event_id, concat('q13', lpad(CAST(len(c) AS VARCHAR), 2, '0'), lpad(CAST(len(e) AS VARCHAR), 2, '0'), 'h_',
    left(sha256(array_to_string(list_transform(list_sort(c), lambda x: lpad(lower(to_hex(x)), 4, '0')), ',')), 12), '_', left(sha256(array_to_string(list_transform(list_sort(list_filter(e, lambda x: x NOT IN (0, 16))), lambda x: lpad(lower(to_hex(x)), 4, '0')), ',')), 12)) AS ja4 FROM x""")
def _(spark, d):
    return hellos(spark, d).select("event_id", fingerprint.ja4("v", "c", "e", F.lit(None).cast("string"), F.array(F.lit("h3")), F.array(F.lit(772)), quic=True).alias("ja4"))


@query("prd_grease", "SELECT event_id, (n & 3855) = 2570 AS grease, CASE n % 6 WHEN 0 THEN 'SSL 3.0' WHEN 1 THEN 'TLS 1.0' WHEN 2 THEN 'TLS 1.1' WHEN 3 THEN 'TLS 1.2' WHEN 4 THEN 'TLS 1.3' ELSE 'Unknown (0x0305)' END AS version FROM (SELECT event_id, event_id % 65536 AS n FROM events)")
def _(spark, d):
    n = F.col("event_id") % 65536
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", fingerprint.is_grease(n).alias("grease"), fingerprint.tls_version(768 + n % 6).alias("version"))


# ---- shares, pipes, files

_SHARE = "CASE event_id % 8 WHEN 0 THEN '\\\\srv\\ADMIN$' WHEN 1 THEN 'c$' WHEN 2 THEN 'share' WHEN 3 THEN 'IPC$' WHEN 4 THEN 'Z$' WHEN 5 THEN 'docs' WHEN 6 THEN 'print$' ELSE '' END"
_FILE = "CASE event_id % 9 WHEN 0 THEN 'PSEXESVC.exe' WHEN 1 THEN 'svcctl' WHEN 2 THEN 'winreg' WHEN 3 THEN 'run.ps1' WHEN 4 THEN 'notes.txt' WHEN 5 THEN 'remcom' WHEN 6 THEN 'a.dll' WHEN 7 THEN 'eventlog' ELSE 'x.bat' END"


def shares(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.expr(_SHARE.replace("\\", "\\\\")).alias("share"), F.expr(_FILE).alias("file"))


_S = f"WITH s AS (SELECT event_id, {_SHARE} AS share, {_FILE} AS file FROM events)"
_any = lambda c, xs: "(" + " OR ".join(f"contains(upper({c}), '{x}')" for x in xs) + ")"
_ADMIN = f"({_any('share', ADMIN_SHARES)} OR regexp_matches(upper(share), '^[A-Z]\\$'))"
_PSEXEC = f"((contains(upper(share), 'ADMIN$') AND (contains(upper(file), 'PSEXE') OR contains(upper(file), 'PAEXEC'))) OR {_any('file', REMOTE_EXEC_TOOLS)})"
_UPLOAD = f"({_ADMIN} AND regexp_matches(upper(file), '\\.(EXE|DLL|SCR|BAT|CMD|PS1|VBS|JS|WSF|MSI|COM)$'))"


@query("smb_admin_share", f"{_S} SELECT event_id, {_ADMIN} AS hit FROM s")
def _(spark, d):
    return shares(spark, d).select("event_id", content.is_admin_share("share").alias("hit"))


@query("smb_psexec", f"{_S} SELECT event_id, {_PSEXEC} AS psexec, {_any('file', SERVICE_PIPES)} AS service, {_any('file', WMI_PIPES)} AS wmi, {_UPLOAD} AS upload FROM s")
def _(spark, d):
    return shares(spark, d).select(
        "event_id", content.is_remote_exec("file", "share").alias("psexec"), content.is_service_pipe("file").alias("service"), content.is_wmi_pipe("file").alias("wmi"), content.is_suspicious_upload("file", "share").alias("upload")
    )


_EVENTS = f"list_filter([CASE WHEN {_ADMIN} THEN 'ADMIN_SHARE_ACCESS' END, CASE WHEN {_PSEXEC} THEN 'PSEXEC' END, CASE WHEN {_any('file', SERVICE_PIPES)} THEN 'SERVICE_CREATE' END, CASE WHEN {_any('file', WMI_PIPES)} THEN 'WMI_EXEC' END, CASE WHEN {_UPLOAD} THEN 'SUSPICIOUS_UPLOAD' END], lambda x: x IS NOT NULL)"


@query("smb_lateral", f"{_S}, l AS (SELECT event_id, unnest({_EVENTS}) AS kind FROM s) SELECT event_id, kind, CASE kind WHEN 'ADMIN_SHARE_ACCESS' THEN 7 WHEN 'PSEXEC' THEN 9 ELSE 8 END AS severity FROM l")
def _(spark, d):
    return content.lateral_events(shares(spark, d), "file", "share").select("event_id", "kind", "severity")


_POINTS = "CASE kind WHEN 'ADMIN_SHARE_ACCESS' THEN 2 ELSE 3 END"


@query("win_cumscore", f"""{_S}, l AS (SELECT event_id, event_id % 150 AS session, unnest({_EVENTS}) AS kind FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY kind) AS seq FROM l),
    c AS (SELECT session, event_id, kind, CAST(sum({_POINTS}) OVER (PARTITION BY session ORDER BY event_id, seq) AS BIGINT) AS score FROM p) SELECT session, event_id, kind, score, score >= 3 AS alert FROM c""")
def _(spark, d):
    e = content.lateral_events(shares(spark, d), "file", "share").withColumn("session", F.col("event_id") % 150)
    return content.lateral_scores(e, ["session"], ["event_id", "kind"]).select("session", "event_id", "kind", "score", "alert")


@query("agg_lateral", f"""{_S}, l AS (SELECT event_id % 150 AS session, unnest({_EVENTS}) AS kind FROM s) SELECT session, count(*) FILTER (kind = 'ADMIN_SHARE_ACCESS') AS admin_hits, count(*) FILTER (kind IN ('SERVICE_CREATE', 'WMI_EXEC')) AS pipes, count(*) FILTER (kind = 'SUSPICIOUS_UPLOAD') AS uploads, CAST(sum({_POINTS}) AS BIGINT) AS score FROM l GROUP BY 1""")
def _(spark, d):
    e = content.lateral_events(shares(spark, d), "file", "share").withColumn("session", F.col("event_id") % 150)
    return content.lateral_totals(e, ["session"]).select("session", "admin_hits", "pipes", "uploads", "score")


@query("smb_sanitize", f"{_S} SELECT event_id, left(ltrim(regexp_replace(concat(file, '<', event_id, '>'), '[^a-zA-Z0-9._-]', '_', 'g'), '.'), 100) AS name FROM s")
def _(spark, d):
    path = F.concat(F.lit("dir/x\\"), "file", F.lit("<"), F.col("event_id").cast("string"), F.lit(">"))
    return shares(spark, d).select("event_id", content.sanitized(path).alias("name"))


@query("prs_http_ext", f"SELECT event_id, {sql_case('t', EXTENSIONS, chr(39) + '.bin' + chr(39))} AS extension FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/json' WHEN 3 THEN 'odd/type' ELSE 'video/mp4' END AS t FROM events)")
def _(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Text/HTML; charset=utf-8", "image/png", "application/json", "odd/type", "video/mp4"))), (F.col("event_id") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", content.extension_of(kind).alias("extension"))


_MIME = "CASE event_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'application/zip' WHEN 4 THEN 'application/x-dosexec' WHEN 5 THEN 'application/vnd.ms-spreadsheet' ELSE 'text/html' END"


@query("crv_category", f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'media' WHEN 2 THEN 'document' WHEN 3 THEN 'archive' WHEN 4 THEN 'executable' WHEN 5 THEN 'document' ELSE 'other' END AS category FROM events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", content.category_of(F.expr(_MIME)).alias("category"))


@query("crv_threat", "SELECT page_id, contains(left(html, 1024), '<script') OR contains(left(html, 1024), '<?php') OR contains(left(html, 1024), '#!/') OR contains(left(html, 1024), 'powershell') OR contains(left(html, 1024), 'cmd.exe') AS threat FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", content.is_threat(F.lit("text/html"), F.col("html")).alias("threat"))


_KINDS = " ".join(f"WHEN contains(lower(text), '{w}') THEN 'Suspicious content: {w}'" for w in SUSPICIOUS_CONTENT)


@query("smb_content", f"""SELECT doc_id, CASE WHEN starts_with(text, 'MZ') THEN 'Executable file' {_KINDS} END AS kind
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'MZ' WHEN 1 THEN 'x PowerShell -enc ' WHEN 2 THEN 'run CMD.exe ' ELSE '' END || text AS text FROM documents)""")
def _(spark, d):
    t = F.concat(F.expr("CASE doc_id % 4 WHEN 0 THEN 'MZ' WHEN 1 THEN 'x PowerShell -enc ' WHEN 2 THEN 'run CMD.exe ' ELSE '' END"), "text")
    return docs(spark, d).select("doc_id", content.suspicious_content(t, F.lit("a.txt")).alias("kind"))


@query("smb_mime", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'image/png' ELSE 'text/plain' END AS mime FROM documents""")
def _(spark, d):
    head = F.expr("unhex(CASE doc_id % 4 WHEN 0 THEN '25504446' WHEN 1 THEN '504B0304' WHEN 2 THEN '89504E47' ELSE '61626364' END)")
    return docs(spark, d).select("doc_id", content.magic_mime(head).alias("mime"))


@query("flt_hexsearch", "SELECT doc_id, (length(t) - length(replace(t, 'th', ''))) // 2 AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(content.pattern_offsets(F.col("text").cast("binary"), "th")).cast("long").alias("hits"))


@query("crv_sig_lookup", "SELECT 'executable' AS category, 7 AS signatures, 7 AS dangerous UNION ALL SELECT 'media', 10, 0 UNION ALL SELECT 'image', 8, 0 UNION ALL SELECT 'document', 6, 0 UNION ALL SELECT 'archive', 7, 0 UNION ALL SELECT 'database', 1, 0 UNION ALL SELECT 'certificate', 1, 0")
def _(spark, d):
    s = content.signatures(spark)
    return s.groupBy("category").agg(F.count("*").cast("int").alias("signatures"), F.count_if("dangerous").cast("int").alias("dangerous"))


@query("set_union_pii", f"WITH f AS ({_sql_found(['email', 'phone'], PII_PATTERNS)}) SELECT doc_id, type, count(*) AS n FROM f GROUP BY ALL")
def _(spark, d):
    t = docs(spark, d).select("doc_id", "text")
    both = pii.matches(t, "text", ["email"], least=0.0).unionByName(pii.matches(t, "text", ["phone"], least=0.0))
    return both.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
