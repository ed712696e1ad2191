"""Documents among pictures: candidates, classes of their text by signatures and rules, and what a scan writes back.

Signatures are expressions within a row. Rules are a table: tasks find the keywords in texts by words and what is left of these without a character, and
an equi-join brings the rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.readings import held_words, misread_bits, one_edit, words_of
from shutterlake.functions.scalars import fuzzy_words
from shutterlake.operators.classify import social_signals
from shutterlake.operators.once import made_once
from shutterlake.session import cut, written
from shutterlake.sources.media import media_type

#: Scores from which a text is a document, and sharpness below which a picture is blurred.
DOCUMENT_SCORE, BLUR = 40, 120
#: Words in file names that make a picture a candidate.
CANDIDATE_NAMES = (
    "aadhaar", "aadhar", "pancard", "pan_card", "passport", "voter_id", "driving_licence", "driving_license", "marksheet", "certificate", "invoice", "receipt",
    "tax_invoice", "salary_slip", "payslip", "bank_statement", "passbook", "electricity_bill", "water_bill", "rc_book", "vehicle_rc", "pollution_certificate",
    "puc", "doc", "scan",
)
#: Words of categories, in the order in which categories are tried.
CATEGORY_WORDS = {
    "Government & Identity": (
        "aadhaar", "aadhar", "adhar", "adhaar", "uidai", "pan", "pancard", "pan_card", "income_tax", "passport", "voter", "epic", "election", "driving", "licence",
        "license", "dl_no", "rto", "ration", "id_card", "idcard", "identity_card", "identity", "caste", "domicile", "birth_cert", "death_cert",
    ),
    "Banking & Finance": (
        "bank", "statement", "passbook", "cheque", "check", "deposit", "withdrawal", "tax", "itr", "form16", "form_16", "credit_card", "loan", "emi", "insurance",
        "policy", "mutual_fund",
    ),
    "Utility Bills": (
        "bill", "receipt", "electricity", "bescom", "tneb", "mseb", "water", "gas", "lpg", "indane", "hp_gas", "bharat_gas", "broadband", "wifi", "internet", "airtel",
        "jio", "vi", "bsnl", "telephone", "mobile_bill", "utility",
    ),
    "Business & Invoices": (
        "invoice", "inv_", "tax_invoice", "purchase_order", "po_", "quotation", "estimate", "challan", "delivery_note", "gst", "gstin", "bill_of_supply",
        "sales_receipt", "cash_memo",
    ),
    "Medical": (
        "prescription", "rx", "doctor", "hospital", "clinic", "lab_report", "blood_test", "mri", "xray", "x_ray", "ct_scan", "discharge_summary", "diagnosis", "vaccine",
        "vaccination",
    ),
    "Education & Career": (
        "marksheet", "grade_sheet", "transcript", "degree", "diploma", "certificate", "admit_card", "hall_ticket", "resume", "cv", "offer_letter", "payslip",
        "salary_slip", "experience_letter", "relieving_letter", "internship", "recommendation",
    ),
    "Legal & Property": (
        "agreement", "lease", "rent_agreement", "sale_deed", "deed", "property_tax", "khata", "registry", "affidavit", "notary", "power_of_attorney", "stamp_paper",
        "bond", "court_order",
    ),
}
GENERAL_WORDS = ("doc_", "doc-", "scan_", "scan-", "document", "receipt", "invoice", "statement", "certificate", "form", "letter", "slip", "report")
IDENTITY, COMMERCE, TRAVEL, FINANCE = "Government & Identity", "Business & Commerce", "Travel", "Banking & Finance"


class Rule(NamedTuple):
    """A class of documents: one of ``required`` must be there, none of ``negative``; the others add points."""

    id: int
    name: str
    category: str
    required: tuple[str, ...]
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    regex: str = ""


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def read_words(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_low``, the text in lower case, and ``_words``, its fuzzy words, made once."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return made_once(docs, _low=low, _words=fuzzy_words(low))


#: Keywords of signatures that may be misread, by (word, edits).
MISREAD = (
    *((k, 1) for k in ("aadhaar", "aadhar", "uidai", "unique identification", "mera aadhaar", "enrolment", "passport", "elector")),
    *((k, 2) for k in ("income tax", "permanent account", "republic of india", "election commission", "voter id", "driving licence", "driving license")),
)


def identity_signature(text: Column, quality: Column, low: Column) -> Column:
    """``struct(type, category, confidence)`` of the first signature that a text bears, null if none or if it looks like a social post; confidence is lower below a reading quality of 70.

    ``low`` is the text in lower case.
    """
    bits = misread_bits(low, MISREAD)
    fuzzy = lambda k, n: bits.bitwiseAND(F.lit(1 << MISREAD.index((k, n)))) > 0
    has = lambda *ks: _any([F.contains(low, F.lit(k)) for k in ks])
    every = lambda *ks: _all([F.contains(low, F.lit(k)) for k in ks])
    number = r"\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b"
    named = sum((fuzzy(k, 1).cast("int") for k in ("aadhaar", "aadhar", "uidai", "unique identification", "mera aadhaar", "enrolment")), F.lit(0))
    digits = text.rlike(number) | F.translate(text, "OoIl|SsBZz", "0011155822").rlike(number)
    tax = fuzzy("income tax", 2) | fuzzy("permanent account", 2) | every("income", "tax")
    seller = low.rlike(r"\b(tax invoice|bill of supply|invoice number|order number|shipping address|billing address|sold by)\b")
    airline = has("indigo", "air india", "spicejet", "vistara", "flight to", "flight ticket", "boarding pass")
    paid = has("transaction successful", "payment successful", "scan qr code to pay", "paid to")
    rules = [
        ("Aadhaar Card", IDENTITY, 85, (digits & ((named >= 1) | has("government of india", "govt of india"))) | (named >= 2)),
        ("PAN Card", IDENTITY, 85, ~seller & ((text.rlike(r"\b[A-Z]{5}\d{4}[A-Z]\b") & (tax | has("pan card", "father"))) | (tax & has("father", "dob")))),
        ("Passport", IDENTITY, 85, fuzzy("republic of india", 2) | (fuzzy("passport", 1) & has("type p", "given name"))),
        ("Voter ID Card", IDENTITY, 85, fuzzy("election commission", 2) | fuzzy("elector", 1) | (fuzzy("voter id", 2) & has("india"))),
        ("Driving License", IDENTITY, 85, fuzzy("driving licence", 2) | fuzzy("driving license", 2) | every("dl no", "valid")),
        ("Birth Certificate", IDENTITY, 85, has("birth certificate", "certificate of birth", "art certihcate")
            | (has("date of birth", "place of birth", "placo of birth") & has("mother", "father") & has("hospital", "registration", "medical officer"))),
        ("Tax Invoice", COMMERCE, 90, low.rlike(r"\b(tax invoice|bill of supply|cash memo|invoice/bill of supply)\b") | every("original for recipient", "sold by")
            | (has("sold by") & has("billing address", "pan no", "gstin"))),
        ("Train Ticket", TRAVEL, 90, has("irctc") | every("rail reservation", "ticket confirmation") | every("passenger details", "ticket fare", "convenience fee")),
        ("Flight Ticket", TRAVEL, 90, airline & has("itinerary", "terminal", "departure", "arrival", "boarding")),
        ("UPI Receipt", FINANCE, 90, paid & has("utr", "transaction id", "debited from", "@kbl", "@upi", "upi ref")),
    ]
    found = lambda name, category, points: F.struct(F.lit(name).alias("type"), F.lit(category).alias("category"), points.alias("confidence"))
    sure = lambda low_points: F.when(quality >= 70, 100).otherwise(low_points)
    cases = [F.when(cond, found(name, category, sure(points))) for name, category, points, cond in rules]
    cinema = has("share your ticket", "booking id:") & has("pvr", "inox", "cinepolis", "audi", "ticket(s)")
    cases.append(F.when(cinema, found("Event Ticket", TRAVEL, F.lit(90))))
    return F.when(F.size(social_signals(text)) == 0, F.coalesce(*cases))


#: Characters from which on a keyword may differ by an edit, and up to which it may even where it counts as a weak word.
FUZZY, WEAK_FUZZY = 5, 7
#: Rules that may be sent to where the texts are, and texts whose hits a task holds.
MOST_RULES, HELD = 10_000, 256


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Rules as rows: ``at`` (their order), name, category, required, strong, weak, negative and regex."""
    if isinstance(rules, DataFrame):
        return rules
    rows = [(at, r.name, r.category, *map(list, (r.required, r.strong, r.weak, r.negative)), r.regex) for at, r in enumerate(rules)]
    return spark.createDataFrame(rows, "at int, name string, category string, required array<string>, strong array<string>, weak array<string>, negative array<string>, regex string")


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(_row, keyword, near)``: the ``keywords(keyword)`` that ``texts(_row, _low)`` hold as they are, and, ``near``, those that they hold up to one edit.

    Under three characters a keyword must stand as a word, else anywhere. From ``FUZZY`` characters on a word, or a run of as many words as it has, may
    differ by an edit: both sides are looked up by what is left of them without a character, and a task looks up each distinct word once.
    """
    every = [r[0] for r in keywords.select("keyword").limit(100 * MOST_RULES + 1).collect()]
    if len(every) > 100 * MOST_RULES:
        raise ValueError("keywords are sent to where the texts are; there are too many of them")
    short = [k for k in every if len(k) < 3]

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, spelt = held_words([k for k in every if len(k) >= 3]), one_edit(every, FUZZY)
        for frame in frames:
            for at in range(0, len(frame), HELD):
                part = frame.iloc[at : at + HELD]
                found = [(row, k, near) for row, low in zip(part["_row"], part["_low"], strict=True) for near, ks in ((False, held(low)), (True, spelt(words_of(low)))) for k in ks]
                yield pd.DataFrame(found, columns=["_row", "keyword", "near"])

    found = texts.select("_row", "_low").mapInPandas(hits, "_row long, keyword string, near boolean")
    if not short:
        return found
    stands = lambda k: F.rlike(F.col("_low"), F.concat(F.lit(r"\b\Q"), k, F.lit(r"\E\b")))
    both = texts.select("_row", "_low").crossJoin(F.broadcast(keywords.filter(F.length("keyword") < 3).agg(F.collect_set("keyword").alias("_keywords"))))  # one row
    return found.unionByName(both.select("_row", F.explode(F.filter("_keywords", stands)).alias("keyword"), F.lit(False).alias("near")))


def with_best_rule(docs: DataFrame, rules: Sequence[Rule] | DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_low``, the text in lower case, and ``_rule``: ``struct(type, category, points)`` of the rule with most points, the earlier of equals; null if none has a required word, or the text fewer than three words.

    Points: 35, 30 for the pattern, 15 for each strong and 5 for each weak word. Words may be misread by a letter (``keyword_hits``). Rules are rows,
    and meet the texts by their keywords: the plan is the same for any number of them.
    """
    spark = docs.sparkSession
    table = cut(rule_table(spark, rules))
    if table.count() > MOST_RULES:
        raise ValueError("rules are sent to where the texts are; there are too many of them")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    texts = written(docs.withColumns({"_low": low, "_row": F.monotonically_increasing_id()}), "texts")
    each = [table.select("at", F.lit(role).alias("role"), F.posexplode(role).alias("no", "keyword")) for role in ("required", "strong", "weak", "negative")]
    terms = cut(reduce(DataFrame.unionByName, each).withColumn("keyword", F.lower("keyword")).filter(F.length("keyword") > F.when(F.col("role") == "negative", 2).otherwise(0)))
    hits = keyword_hits(texts, terms.select("keyword").distinct())
    counts = ~F.col("near") | F.col("role").isin("required", "strong") | ((F.col("role") == "weak") & (F.length("keyword") <= WEAK_FUZZY))
    found = hits.join(F.broadcast(terms), "keyword").filter(counts).select("_row", "at", "role", "no").distinct()
    n = lambda role: F.count_if(F.col("role") == role).alias(role)
    fit = found.groupBy("_row", "at").agg(*map(n, ("required", "strong", "weak", "negative"))).filter("required > 0 and negative = 0")
    fit = fit.join(F.broadcast(table.select("at", "name", "category", "regex")), "at").join(texts.select("_row", F.coalesce(text, F.lit("")).alias("_read")), "_row")
    pattern = F.when((F.length("regex") >= 4) & F.regexp_like("_read", F.concat(F.lit("(?i)"), "regex")), 30).otherwise(0)
    points = (pattern + 35 + 15 * F.col("strong") + 5 * F.col("weak")).cast("int")
    enough = fit.filter(F.regexp_count("_read", F.lit(r"\S+")) >= 3).select("_row", "at", F.struct(F.col("name").alias("type"), "category", points.alias("points")).alias("rule"))
    best = enough.groupBy("_row").agg(F.max_by("rule", F.struct("rule.points", -F.col("at"))).alias("_rule"))
    return texts.join(best, "_row", "left").drop("_row")


def classify_text(docs: DataFrame, rules: Sequence[Rule] | DataFrame, text: str = "text", quality: Column | None = None) -> DataFrame:
    """``docs`` with ``is_document``, ``doc_type``, ``doc_category`` and ``confidence``: social posts never, signatures first, then rules with at least 40 points."""
    t, low = F.coalesce(F.col(text), F.lit("")), F.col("_low")
    quality = F.lit(85) if quality is None else quality
    dated = F.when(t.rlike(r"\b\d{2}[/.-]\d{2}[/.-]\d{4}\b"), 10).otherwise(0)
    money = F.when(t.rlike(r"[$₹€£]\s?\d+") | low.rlike(r"\b(total|amount|subtotal|balance)\s*:?\s*\d+"), 10).otherwise(0)
    named = made_once(with_best_rule(docs, rules, text), _own=identity_signature(t, quality, low), _social=F.size(social_signals(t)) > 0)
    named = named.withColumn("_ruled", F.when(F.col("_rule").isNotNull(), F.least(F.lit(100), F.col("_rule.points") + dated + money)))
    found = lambda x, points: F.struct(F.col(f"{x}.type").alias("type"), F.col(f"{x}.category").alias("category"), points.alias("confidence"))
    both = F.when(F.col("_social"), F.lit(None)).when(F.col("_own").isNotNull(), found("_own", F.col("_own.confidence"))).when(F.col("_ruled") >= DOCUMENT_SCORE, found("_rule", F.col("_ruled")))
    named = named.withColumn("_class", both)
    return named.withColumns({
        "is_document": F.col("_class").isNotNull(), "doc_type": F.coalesce("_class.type", F.lit("not_a_document")), "doc_category": F.col("_class.category"),
        "confidence": F.coalesce("_class.confidence", F.lit(0)),
    }).drop("_class", "_low", "_own", "_rule", "_social", "_ruled")


def readable(text: Column) -> Column:
    """Whether a scan has left a text of more than five characters."""
    return F.coalesce((F.length(text) > 5) & ~text.isin("NONE", "ERROR"), F.lit(False))


def reclassified(photos: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``photos`` with is_document and document_category anew for those with a stored text, and ``change``: kept, cleared, or null where nothing was stored or lost."""
    out = classify_text(photos.withColumn("_was", F.coalesce("is_document", F.lit(False))), rules, "extracted_text")
    done, found = readable(F.col("extracted_text")), F.col("is_document")
    change = F.when(done & found, "kept").when(done & F.col("_was"), "cleared")
    out = out.withColumns({"document_category": F.when(done, F.when(found, F.col("doc_category"))).otherwise(F.col("document_category")), "change": change})
    return out.withColumn("is_document", F.when(done, found).otherwise(F.col("_was"))).drop("_was", "doc_type", "doc_category", "confidence")


def document_candidate(photos: DataFrame) -> Column:
    """Whether a picture is worth reading: by its name, a text it has already, or its tones and edges (saturation, edge_density, white_ratio, dark_ratio, hv_ratio)."""
    name = F.lower(F.coalesce("filename", F.lit("")))
    film = F.coalesce(F.col("mime_type").startswith("video"), F.lit(False)) | name.rlike(r"\.(mov|mp4|m4v|avi)$")
    told = name.rlike("|".join(CANDIDATE_NAMES)) | name.endswith(".pdf")
    if "saturation" not in photos.columns:
        return ~film & (told | readable(F.col("extracted_text")))
    sat, edges, white, dark, ratio = (F.col(c) for c in ("saturation", "edge_density", "white_ratio", "dark_ratio", "hv_ratio"))
    paper = (white > 0.25) & (edges > 0.05) & (sat < 0.25)
    lines = (sat < 0.25) & (edges > 0.06) & ((ratio > 1.10) | (white > 0.15) | (dark > 0.15))
    card = (sat < 0.45) & (edges > 0.08) & (ratio > 1.10)
    plain = (sat < 0.35) & (edges > 0.06)
    return ~film & (told | readable(F.col("extracted_text")) | F.coalesce((sat <= 0.55) & (paper | lines | card | plain), F.lit(False)))


def scanned_documents(photos: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``photos`` as a document scan leaves them: those that aren't candidates have the text NONE and no class, candidates the class of their text, NONE if they have none."""
    candidate, failed = document_candidate(photos), F.col("extracted_text") == "ERROR"
    out = classify_text(photos.withColumn("_candidate", candidate), rules, "extracted_text")
    known = F.col("_candidate") & readable(F.col("extracted_text")) & F.col("is_document")
    text = F.when(F.col("_candidate"), F.when(failed, "ERROR").otherwise(F.coalesce(F.nullif("extracted_text", F.lit("")), F.lit("NONE")))).otherwise("NONE")
    out = out.withColumns({"_known": known, "document_category": F.when(known, F.col("doc_category")), "extracted_text": text})
    return out.withColumn("is_document", F.col("_known")).drop("_known", "_candidate", "doc_type", "doc_category", "confidence")


def quality_flags(docs: DataFrame) -> DataFrame:
    """``docs(blur_score, glare, is_document, confidence)`` with ``blurry``, ``quality_points`` (-10 for blur and for glare, for the record) and confidence capped at 80 where blurred."""
    blurry = F.coalesce(F.col("blur_score") < BLUR, F.lit(False))
    points = F.when(blurry, -10).otherwise(0) + F.when(F.col("glare"), -10).otherwise(0)
    sure = F.when(F.col("is_document"), F.when(blurry, F.least(F.lit(80), F.col("confidence"))).otherwise(F.col("confidence"))).otherwise(0)
    return docs.withColumns({"blurry": blurry, "quality_points": points, "confidence": sure})


def local_document(photos: DataFrame) -> DataFrame:
    """``photos`` with ``local_category`` and ``local_confidence``: known (95), by media type (90), by words of a category (85) or general ones (75), by shape without a camera (60), else 0."""
    name, path, text = (F.lower(F.coalesce(c, F.lit(""))) for c in ("filename", "file_path", "extracted_text"))
    mime = F.lower(F.coalesce("mime_type", F.lit("")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == "" if c in photos.columns else F.lit(True)
    any_of = lambda ks: "(" + "|".join(ks) + ")"
    speaks = lambda ks: name.rlike(any_of(ks)) | path.rlike(r"[/\\]" + any_of(ks)) | text.rlike(any_of(ks))
    ratio = F.when((F.col("width") > 0) & (F.col("height") > 0), F.greatest("width", "height") / F.least("width", "height"))
    shaped = blank("make") & blank("model") & (F.col("width") >= 600)
    found = lambda category, points: F.struct(category.alias("category"), F.lit(points).alias("confidence"))
    case = F.when(F.col("is_document"), found(F.coalesce(F.nullif("document_category", F.lit("")), F.lit("General Document")), 95))
    case = case.when(mime.rlike("pdf|text|document|word|sheet"), found(F.lit("General Document"), 90))
    for category, ks in CATEGORY_WORDS.items():
        case = case.when(speaks(ks), found(F.lit(category), 85))
    case = case.when(name.rlike(any_of(GENERAL_WORDS)) | path.rlike(any_of(GENERAL_WORDS)), found(F.lit("General Document"), 75))
    case = case.when(shaped & ratio.between(1.54, 1.62), found(F.lit(IDENTITY), 60)).when(shaped & ratio.between(1.38, 1.45), found(F.lit("General Document"), 60))
    out = made_once(photos, _found=case.otherwise(found(F.lit("Non-Document"), 0)))
    return out.withColumns({"local_category": F.col("_found.category"), "local_confidence": F.col("_found.confidence")}).drop("_found")


def default_results(files: DataFrame, disk: DataFrame) -> DataFrame:
    """``files(file_path)`` that a classifier can't look at, with the result each stands with: keep, photo, not_a_document and score 0. Files that the disk lacks are missing, others of no known kind unsupported."""
    there = files.join(disk.select(F.col("path").alias("file_path")).distinct().withColumn("_there", F.lit(True)), "file_path", "left")
    kind = media_type(F.col("file_path"))["kind"]
    reason = F.when(F.col("_there").isNull(), "missing").when(F.coalesce(kind.isin("document"), F.lit(True)), "unsupported")
    out = there.withColumn("reason", reason).filter("reason is not null").drop("_there")
    return out.withColumns({"junk_class": F.lit("keep"), "shot_class": F.lit("photo"), "doc_type": F.lit("not_a_document"), "score": F.lit(0)})


def build_rules(texts: DataFrame) -> DataFrame:
    """Rules from knowledge-base texts ``texts(category, text)``: ``id, name, category, required, strong, weak, negative, regex``, one row for each number, the one with most required words.

    An entry starts with its number and name; fields follow as ``Required Keywords:``, ``Strong Indicators:``, ``Weak Indicators:``, ``Negative Keywords:`` and ``Regex:``. Words are
    separated by commas or semicolons; indicators also by blanks, three letters at least. Entries without required words give no rule.
    """
    flat = F.regexp_replace(F.regexp_replace("text", "={10,}", " "), r"\s+", " ")
    entries = texts.select("category", F.explode(F.split(flat, r"(?=\b[0-9]{1,3}\.\s+[A-Za-z])")).alias("entry"))
    fields = "Category:|(?:Required |Optional )?Keywords:|Strong Indicators:|Weak Indicators:|Negative Keywords:|(?:Common )?OCR Mistakes:|Regex:|Notes:"
    field = lambda name: F.trim(F.regexp_extract("entry", rf"(?i){name}:\s*(.*?)(?=\s*(?:{fields}|$))", 1))
    listed = lambda c, marks: F.array_distinct(F.filter(F.transform(F.split(F.lower(c), marks), F.trim), lambda w: F.length(w) >= 3))
    regex = field("Regex")
    out = entries.select(
        F.regexp_extract("entry", r"^\s*([0-9]{1,3})\.", 1).try_cast("int").alias("id"),
        F.trim(F.regexp_extract("entry", rf"(?i)^\s*[0-9]{{1,3}}\.\s+(.*?)(?=\s*(?:{fields}|$))", 1)).alias("name"),
        F.coalesce(F.nullif(field("Category"), F.lit("")), "category").alias("category"), listed(field("(?:Required )?Keywords"), "[,;]").alias("required"),
        listed(field("Strong Indicators"), r"[,;\s]").alias("strong"), listed(field("Weak Indicators"), r"[,;\s]").alias("weak"), listed(field("Negative Keywords"), "[,;]").alias("negative"),
        F.when(F.lower(regex).rlike(r"vary|none|^\?\?$"), "").otherwise(regex).alias("regex"),
    ).filter("id is not null and size(required) > 0")
    best = out.groupBy("id").agg(F.max_by(F.struct(*out.columns), F.struct(F.size("required"), "name")).alias("x"))
    return best.select("x.*")
