"""Queries of document classes and scans, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import scalars as K
from shutterlake.operators import classify, documents
from shutterlake.operators.documents import Rule
from shutterlake.operators.once import made_once
from shutterlake.plans.views import Catalog, duckdb_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return put


#: What stands after each document's own text, by its id.
PHRASES = (
    " Government of India 2345 6789 0123", " aadhar enrolment number 2O45 6789 OI23 aadhaar", " income tax permanent account father ABCDE1234F", " republik of india passport", " passport type P given name",
    " election comission of india", " driving license no 12 valid", " certificate of birth", " date of birth mother hospital", " TAX INVOICE total: 45 $90", " sold by shop pan no 7", " irctc", " rail reservation ticket confirmation",
    " boarding pass terminal 2", " payment successful utr 1", " booking id: 7 pvr", " POV: invoice lmao", " the electricty bill amount: 100 due 01/02/2020 unit charges", " water supply board meter reading subtotal 45",
    " laboratory raport patient name ref by doctor 9876543210", " lab report patient negative word", " nothing else", "", " visit r/pics and the invoice number",
)
RULES = (
    Rule(1, "Electricity Bill", "Utility Bills", ("electricity bill", "energy bill"), ("unit charges", "consumer"), ("due", "amount"), ("water",)),
    Rule(2, "Water Bill", "Utility Bills", ("water supply",), ("meter reading",), ("subtotal",), ()),
    Rule(3, "Lab Report", "Medical", ("laboratory report", "lab report"), ("patient name",), ("ref", "doctor"), ("negative word",), r"\b[0-9]{10}\b"),
    Rule(4, "Any Report", "Medical", ("report", "lab report"), ("patient name",), (), ()),
)
PHRASE = f"CASE doc_id % {len(PHRASES)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"
SAID = f"coalesce(text, '') || {PHRASE}"


def esc(word: str) -> str:
    return word.replace("'", "''")


#: Keywords that are matched with reading errors, by (word, edits), as queries name them.
FUZZY: set[tuple[str, int]] = set()


def fuzzy_sql(word: str, most: int) -> str:
    n = len(word)
    allowed = min(2, most) if n >= 8 else 1 if n >= 5 else 0
    if n < 3:
        return rf"regexp_matches(low, '\b{word}\b')"
    if allowed:
        FUZZY.add((word, allowed))
        return f"(contains(low, '{word}') OR coalesce(list_contains(hits, '{word}~{allowed}'), FALSE))"
    return f"contains(low, '{word}')"


def has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def every(*words: str) -> str:
    return "(" + " AND ".join(f"contains(low, '{w}')" for w in words) + ")"


NUMBER = r"\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b"
NAMED = " + ".join(f"{fuzzy_sql(k, 1)}::INT" for k in ("aadhaar", "aadhar", "uidai", "unique identification", "mera aadhaar", "enrolment"))
TAX = f"({fuzzy_sql('income tax', 2)} OR {fuzzy_sql('permanent account', 2)} OR {every('income', 'tax')})"
SELLER = r"regexp_matches(low, '\b(tax invoice|bill of supply|invoice number|order number|shipping address|billing address|sold by)\b')"
SIGNATURES = (
    ("Aadhaar Card", "Government & Identity", rf"((regexp_matches(t, '{NUMBER}') OR regexp_matches(translate(t, 'OoIl|SsBZz', '0011155822'), '{NUMBER}')) AND ({NAMED} >= 1 OR {has('government of india', 'govt of india')})) OR {NAMED} >= 2"),
    ("PAN Card", "Government & Identity", rf"NOT {SELLER} AND ((regexp_matches(t, '\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b') AND ({TAX} OR {has('pan card', 'father')})) OR ({TAX} AND {has('father', 'dob')}))"),
    ("Passport", "Government & Identity", f"{fuzzy_sql('republic of india', 2)} OR ({fuzzy_sql('passport', 1)} AND {has('type p', 'given name')})"),
    ("Voter ID Card", "Government & Identity", f"{fuzzy_sql('election commission', 2)} OR {fuzzy_sql('elector', 1)} OR ({fuzzy_sql('voter id', 2)} AND contains(low, 'india'))"),
    ("Driving License", "Government & Identity", f"{fuzzy_sql('driving licence', 2)} OR {fuzzy_sql('driving license', 2)} OR {every('dl no', 'valid')}"),
    ("Birth Certificate", "Government & Identity", f"{has('birth certificate', 'certificate of birth', 'art certihcate')} OR ({has('date of birth', 'place of birth', 'placo of birth')} AND {has('mother', 'father')} AND {has('hospital', 'registration', 'medical officer')})"),
    ("Tax Invoice", "Business & Commerce", rf"regexp_matches(low, '\b(tax invoice|bill of supply|cash memo|invoice/bill of supply)\b') OR {every('original for recipient', 'sold by')} OR (contains(low, 'sold by') AND {has('billing address', 'pan no', 'gstin')})"),
    ("Train Ticket", "Travel", f"contains(low, 'irctc') OR {every('rail reservation', 'ticket confirmation')} OR {every('passenger details', 'ticket fare', 'convenience fee')}"),
    ("Flight Ticket", "Travel", f"{has('indigo', 'air india', 'spicejet', 'vistara', 'flight to', 'flight ticket', 'boarding pass')} AND {has('itinerary', 'terminal', 'departure', 'arrival', 'boarding')}"),
    ("UPI Receipt", "Banking & Finance", f"{has('transaction successful', 'payment successful', 'scan qr code to pay', 'paid to')} AND {has('utr', 'transaction id', 'debited from', '@kbl', '@upi', 'upi ref')}"),
    ("Event Ticket", "Travel", f"{has('share your ticket', 'booking id:')} AND {has('pvr', 'inox', 'cinepolis', 'audi', 'ticket(s)')}"),
)
SOCIAL = (
    f"(NOT regexp_matches(low, '{'|'.join(classify.DOCUMENT_MARKS)}') AND ("
    + " OR ".join(f"regexp_matches(low, '{esc(p)}')" for p in classify.SOCIAL.values())
    + f" OR (regexp_matches(low, '{classify.CHAT}') AND NOT regexp_matches(low, 'invoice|total'))))"
)
#: Which keywords each text has but for reading errors: of its words, and of its runs of as many words as a keyword has, each tried once.
MISREAD = rf"""kws(kw, allowed, parts) AS (VALUES {{FUZZY}}), t0 AS (SELECT *, lower(t) AS low, list_filter(regexp_split_to_array(lower(t), '[\s,.:;!?''"()\[\]{{{{}}}}/\-_]+'), lambda w: length(w) >= 3) AS ws FROM src),
pos AS (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t0), run AS (SELECT id, parts, array_to_string(ws[i:i + parts - 1], ' ') AS w FROM pos, (SELECT DISTINCT parts FROM kws UNION SELECT 1) p WHERE i + parts - 1 <= len(ws)),
try AS (SELECT DISTINCT parts, w FROM run), hit AS (SELECT try.parts, w, kw || '~' || allowed AS key FROM try JOIN kws ON (try.parts = kws.parts OR try.parts = 1) AND abs(length(w) - length(kw)) <= allowed WHERE levenshtein(w, kw) <= allowed),
own AS (SELECT id, list(DISTINCT key) AS hits FROM run JOIN hit USING (parts, w) GROUP BY id), tx AS (SELECT t0.*, hits FROM t0 LEFT JOIN own USING (id))"""


def misread() -> str:
    """``MISREAD`` with the keywords that queries have named so far."""
    return MISREAD.format(FUZZY=", ".join(f"('{k}', {n}, {len(k.split(' '))})" for k, n in sorted(FUZZY)))


def texts_sql() -> str:
    return rf"""{misread()},
sg AS (SELECT *, {SOCIAL} AS social, CASE {' '.join(f"WHEN {c} THEN {i}" for i, (_, _, c) in enumerate(SIGNATURES))} END AS sig FROM tx)"""


SIG_TABLE = "sigs(sig, stype, scat) AS (VALUES " + ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c, _) in enumerate(SIGNATURES)) + ")"


def rule_sql(r: Rule) -> str:
    points = ["35", *[f"15 * {fuzzy_sql(k, 1)}::INT" for k in r.strong], *[f"5 * {fuzzy_sql(k, 0)}::INT" for k in r.weak]]
    if r.regex:
        points.append(f"30 * regexp_matches(t, '{r.regex}')::INT")
    banned = "".join(f" AND NOT contains(low, '{k}')" for k in r.negative)
    return f"CASE WHEN ({' OR '.join(fuzzy_sql(k, 1) for k in r.required)}){banned} THEN {' + '.join(points)} END"


RULED = f"""rl AS (SELECT *, {', '.join(f"{rule_sql(r)} AS p{i}" for i, r in enumerate(RULES))}, len(regexp_extract_all(t, '\\S+')) >= 3 AS enough FROM sg),
br AS (SELECT *, CASE WHEN enough THEN greatest({', '.join(f'p{i}' for i in range(len(RULES)))}) END AS best FROM rl),
bn AS (SELECT *, CASE {' '.join(f"WHEN p{i} = best THEN {i}" for i in range(len(RULES)))} END AS which FROM br),
rules(which, rtype, rcat) AS (VALUES {', '.join(f"({i}, '{r.name}', '{r.category}')" for i, r in enumerate(RULES))})"""
CLASSED = rf"""{RULED}, {SIG_TABLE}, cl AS (SELECT bn.*, CASE WHEN social THEN NULL WHEN bn.sig IS NOT NULL THEN stype WHEN pts >= 40 THEN rtype END AS ctype, CASE WHEN social THEN NULL WHEN bn.sig IS NOT NULL THEN scat WHEN pts >= 40 THEN rcat END AS ccat,
  CASE WHEN social THEN 0 WHEN bn.sig = 10 THEN 90 WHEN bn.sig IS NOT NULL THEN 100 WHEN pts >= 40 THEN pts ELSE 0 END AS conf
  FROM (SELECT *, CASE WHEN best IS NOT NULL THEN least(100, best + 10 * regexp_matches(t, '\b[0-9]{{2}}[/.-][0-9]{{2}}[/.-][0-9]{{4}}\b')::INT + 10 * (regexp_matches(t, '[$₹€£]\s?[0-9]+') OR regexp_matches(low, '\b(total|amount|subtotal|balance)\s*:?\s*[0-9]+'))::INT) END AS pts FROM bn) bn LEFT JOIN sigs ON sigs.sig = bn.sig LEFT JOIN rules ON rules.which = bn.which)"""
DOCS = f"src AS (SELECT doc_id AS id, {SAID} AS t FROM documents)"


def said(c: Catalog):
    return c.documents.select(F.col("doc_id").alias("id"), F.expr(SAID).alias("text"))


TEXTS = texts_sql()  # after all keywords have been named


@query("k10_fuzzy_includes", f"WITH {DOCS}, {misread()} SELECT id, {fuzzy_sql('passport', 1)} AS one, {fuzzy_sql('election commission', 2)} AS run, {fuzzy_sql('bill', 2)} AS short, {fuzzy_sql('of', 1)} AS word FROM tx")
def _(c):
    found = [K.fuzzy_includes(F.col("_low"), F.col("_words"), F.lit(k), n).alias(a) for k, n, a in (("passport", 1, "one"), ("election commission", 2, "run"), ("bill", 2, "short"), ("of", 1, "word"))]
    return documents.read_words(said(c), "text").select("id", *found)


@query("c3_identity_signatures", f"WITH {DOCS}, {TEXTS}, {SIG_TABLE} SELECT id, stype AS type, scat AS category, CASE WHEN sg.sig = 10 THEN 90 WHEN id % 3 > 0 THEN 100 WHEN sg.sig < 6 THEN 85 ELSE 90 END AS confidence FROM sg JOIN sigs ON sigs.sig = sg.sig WHERE NOT social")
def _(c):
    found = documents.identity_signature(F.col("text"), F.when(F.col("id") % 3 > 0, 70).otherwise(69), F.col("_low"))
    return made_once(said(c).withColumn("_low", F.lower("text")), x=found).filter("x is not null").select("id", "x.type", "x.category", "x.confidence")


@query("c4_taxonomy", f"WITH {DOCS}, {TEXTS}, {RULED} SELECT id, rtype AS type, rcat AS category, CAST(best AS INTEGER) AS points FROM bn JOIN rules ON rules.which = bn.which")
def _(c):
    found = documents.with_best_rule(said(c), RULES, "text")
    return found.filter("_rule is not null").select("id", "_rule.type", "_rule.category", "_rule.points")


@query("c5_classify_text", f"WITH {DOCS}, {TEXTS}, {CLASSED} SELECT id, ctype IS NOT NULL AS is_document, coalesce(ctype, 'not_a_document') AS doc_type, ccat AS doc_category, CAST(conf AS INTEGER) AS confidence FROM cl")
def _(c):
    return documents.classify_text(said(c), RULES).drop("text")


#: Pictures with a text, a class from before, and tones and edges.
PICTURES = f"""pics AS (SELECT id, filename, file_path, mime_type, width, height, make, model, id % 4 = 0 AS is_document, CASE WHEN id % 8 = 0 THEN 'Old' END AS document_category,
  CASE id % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'the' || {PHRASE.replace('doc_id', 'id')} WHEN 3 THEN '' END AS extracted_text, CAST(id % 10 AS DOUBLE) / 10 AS saturation, CAST(id % 13 AS DOUBLE) / 100 AS edge_density,
  CAST(id % 7 AS DOUBLE) / 20 AS white_ratio, CAST(id % 9 AS DOUBLE) / 50 AS dark_ratio, CASE WHEN id % 21 > 0 THEN CAST(id % 3 AS DOUBLE) * 0.6 + 0.5 END AS hv_ratio FROM {{media}})"""


def pictures(c: Catalog):
    i, x = F.col("id"), F.col("id").cast("double")
    part = lambda n, d: (i % n).cast("double") / d
    text = F.when(i % 5 == 0, "NONE").when(i % 5 == 1, "ERROR").when(i % 5 == 2, F.concat(F.lit("the"), F.expr(PHRASE.replace("doc_id", "id")))).when(i % 5 == 3, "")
    own = c.media.select("id", "filename", "file_path", "mime_type", "width", "height", "make", "model")
    ratio = F.when(x % 21 > 0, part(3, 1.0) * 0.6 + 0.5)
    return own.withColumns({
        "is_document": i % 4 == 0, "document_category": F.when(i % 8 == 0, "Old"), "extracted_text": text, "saturation": part(10, 10.0), "edge_density": part(13, 100.0),
        "white_ratio": part(7, 20.0), "dark_ratio": part(9, 50.0), "hv_ratio": ratio,
    })


READ = "coalesce(length(extracted_text) > 5 AND extracted_text NOT IN ('NONE', 'ERROR'), FALSE)"
PICTURE_TEXTS = f"{PICTURES}, src AS (SELECT *, coalesce(extracted_text, '') AS t FROM pics)"
CAND = f"""(NOT (coalesce(mime_type LIKE 'video%', FALSE) OR regexp_matches(lower(filename), '[.](mov|mp4|m4v|avi)$')) AND (regexp_matches(lower(filename), '{'|'.join(documents.CANDIDATE_NAMES)}|[.]pdf$') OR {READ}
  OR coalesce(saturation <= 0.55 AND ((white_ratio > 0.25 AND edge_density > 0.05 AND saturation < 0.25) OR (saturation < 0.25 AND edge_density > 0.06 AND (hv_ratio > 1.10 OR white_ratio > 0.15 OR dark_ratio > 0.15)) OR (saturation < 0.45 AND edge_density > 0.08 AND hv_ratio > 1.10) OR (saturation < 0.35 AND edge_density > 0.06)), FALSE)))"""


@query("c7_reclassify", f"""WITH {PICTURE_TEXTS}, {TEXTS}, {CLASSED} SELECT id, CASE WHEN {READ} THEN ctype IS NOT NULL ELSE is_document END AS is_document, CASE WHEN {READ} THEN ccat ELSE document_category END AS document_category,
  CASE WHEN {READ} AND ctype IS NOT NULL THEN 'kept' WHEN {READ} AND is_document THEN 'cleared' END AS change FROM cl""")
def _(c):
    return documents.reclassified(pictures(c), RULES).select("id", "is_document", "document_category", "change")


@query("c8_scan_documents", f"""WITH {PICTURE_TEXTS}, {TEXTS}, {CLASSED} SELECT id, {CAND} AND {READ} AND ctype IS NOT NULL AS is_document, CASE WHEN {CAND} AND {READ} THEN ccat END AS document_category,
  CASE WHEN NOT {CAND} THEN 'NONE' ELSE coalesce(nullif(extracted_text, ''), 'NONE') END AS extracted_text FROM cl""")
def _(c):
    return documents.scanned_documents(pictures(c), RULES).select("id", "is_document", "document_category", "extracted_text")


@query("m8_document_candidates", f"WITH {PICTURES} SELECT id FROM pics WHERE {CAND}")
def _(c):
    own = pictures(c)
    return own.filter(documents.document_candidate(own)).select("id")


KW = [(cat, k) for cat, ks in documents.CATEGORY_WORDS.items() for k in ks]
LOCAL = f"""kw(ord, cat, k) AS (VALUES {', '.join(f"({i}, '{cat}', '{k}')" for i, (cat, k) in enumerate(KW))}),
lo AS (SELECT *, lower(filename) AS n, lower(file_path) AS p, lower(coalesce(extracted_text, '')) AS t, lower(coalesce(mime_type, '')) AS m, CASE WHEN width > 0 AND height > 0 THEN greatest(width, height)::DOUBLE / least(width, height) END AS ratio FROM pics),
fw AS (SELECT id, arg_min(cat, ord) AS cat FROM lo, kw WHERE contains(n, k) OR contains(p, '/' || k) OR contains(t, k) GROUP BY id)"""
GENERAL = " OR ".join(f"contains(n, '{k}') OR contains(p, '{k}')" for k in documents.GENERAL_WORDS)


@query("m6_local_document", f"""WITH {PICTURES}, {LOCAL}, r AS (SELECT lo.*, fw.cat, {GENERAL} AS gen, coalesce(make, '') = '' AND coalesce(model, '') = '' AND width >= 600 AS sh FROM lo LEFT JOIN fw ON fw.id = lo.id)
SELECT id, CASE WHEN is_document THEN coalesce(document_category, 'General Document') WHEN regexp_matches(m, 'pdf|text|document|word|sheet') THEN 'General Document' WHEN cat IS NOT NULL THEN cat WHEN gen THEN 'General Document'
  WHEN sh AND ratio BETWEEN 1.54 AND 1.62 THEN 'Government & Identity' WHEN sh AND ratio BETWEEN 1.38 AND 1.45 THEN 'General Document' ELSE 'Non-Document' END AS local_category,
  CASE WHEN is_document THEN 95 WHEN regexp_matches(m, 'pdf|text|document|word|sheet') THEN 90 WHEN cat IS NOT NULL THEN 85 WHEN gen THEN 75 WHEN sh AND (ratio BETWEEN 1.54 AND 1.62 OR ratio BETWEEN 1.38 AND 1.45) THEN 60 ELSE 0 END AS local_confidence FROM r""")
def _(c):
    return documents.local_document(pictures(c)).select("id", "local_category", "local_confidence")


@query("m9_default_results", """WITH f AS (SELECT file_path FROM {photos} UNION SELECT path FROM {disk}) SELECT file_path, CASE WHEN file_path NOT IN (SELECT path FROM {disk}) THEN 'missing' ELSE 'unsupported' END AS reason, 'keep' AS junk_class, 'photo' AS shot_class, 'not_a_document' AS doc_type, 0 AS score
FROM f WHERE file_path NOT IN (SELECT path FROM {disk}) OR regexp_matches(file_path, '[.](zip|pdf)$')""")
def _(c):
    files = c.photos.select("file_path").union(c.disk.select("path")).distinct()
    return documents.default_results(files, c.disk)


@query("c10_quality_flags", """SELECT id, coalesce(blur_score < 120, FALSE) AS blurry, CASE WHEN coalesce(blur_score < 120, FALSE) THEN -10 ELSE 0 END + CASE WHEN id % 3 = 0 THEN -10 ELSE 0 END AS quality_points,
  CASE WHEN id % 2 = 1 THEN 0 WHEN coalesce(blur_score < 120, FALSE) THEN least(80, CAST(id % 101 AS INTEGER)) ELSE CAST(id % 101 AS INTEGER) END AS confidence FROM {media}""")
def _(c):
    own = c.media.select("id", "blur_score", (F.col("id") % 3 == 0).alias("glare"), (F.col("id") % 2 == 0).alias("is_document"), (F.col("id") % 101).cast("int").alias("confidence"))
    return documents.quality_flags(own).select("id", "blurry", "quality_points", "confidence")


#: A knowledge base of one text for each brand, an entry for each part.
ENTRY = "CAST(p_partkey % 1000 AS VARCHAR(9)) || '. ' || p_type || ' Category: ' || p_brand || ' Required Keywords: ' || lower(p_name) || ', ' || lower(p_type) || ' Strong Indicators: total, the ' || lower(p_brand) || ' Negative Keywords: draft; not paid Regex: ' || CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE '[0-9]{10}' END"


@query("c9_build_rules", f"""WITH e AS (SELECT CAST(p_partkey % 1000 AS INTEGER) AS id, p_type AS name, p_brand AS category, lower(p_name) AS a, lower(p_type) AS b, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '[0-9]{{10}}' END AS regex FROM part),
r AS (SELECT id, name, category, list_distinct([a, b]) AS required, regex FROM e) SELECT id, max(len(required)) AS n_required, max(name) AS name, 3 AS n_strong, 2 AS n_negative FROM r GROUP BY id""")
def _(c):
    texts = c.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(F.expr(ENTRY))), "\n==========\n").alias("text"))
    rules = documents.build_rules(texts.select(F.col("p_brand").alias("category"), "text"))
    return rules.select("id", F.size("required").alias("n_required"), "name", F.size("strong").alias("n_strong"), F.size("negative").alias("n_negative"))
