"""Reading patient variables against reference ranges.

Markers are a table with one row per band: key, label, unit, kind (numeric or context), direction, aliases, and per band
band_ord, low, high, genders, age_min, age_max. It is a parameter, read from JSON by sources.records.markers().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import first_of

MARKERS = "key string, label string, unit string, kind string, direction string, aliases array<string>, band_ord int, low double, high double, genders array<string>, age_min double, age_max double"


def normal_key(key: Column) -> Column:
    return F.replace(F.lower(F.trim(key)), F.lit(" "), F.lit("_"))


def normal_gender(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("m", "man", "male"), "male").when(v.isin("f", "woman", "female"), "female").otherwise(v)


def status(value: Column, low: Column, high: Column, direction: Column) -> Column:
    """low, high, normal or informational; of a value outside both bounds the direction tells which one is named."""
    below, above = F.coalesce(value < low, F.lit(False)), F.coalesce(value > high, F.lit(False))
    bounded = low.isNotNull() | high.isNotNull() | direction.isin("low_is_bad", "high_is_bad")
    return (
        F.when(direction == "context", "informational")
        .when((direction == "high_is_bad") & above, "high")
        .when(below, "low")
        .when(above, "high")
        .when(bounded, "normal")
        .otherwise("informational")
    )


def profile(variables: DataFrame, markers: DataFrame) -> DataFrame:
    """One row per variable (patient_id, key, value): label, unit, number, low, high, status; `unknown` where no marker has that key or the value is no number.

    A band applies if the patient's gender and age fit; if none fits, the first one does. Markers are few and are sent to all
    tasks if Spark finds them small enough.
    """
    of = variables.withColumn("name", normal_key(F.col("key")))
    # Age and gender of each patient; sex stands in for gender.
    about = of.where(F.col("name").isin("age", "gender", "sex")).groupBy("patient_id").agg(
        F.max(F.when(F.col("name") == "age", F.col("value").try_cast("double"))).alias("age"),
        F.coalesce(F.max(F.when(F.col("name") == "gender", F.col("value"))), F.max(F.when(F.col("name") == "sex", F.col("value")))).alias("gender"),
    )
    names = F.array_distinct(F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>"))))
    table = markers.select(F.explode(F.transform(names, normal_key)).alias("name"), "label", "unit", "kind", "direction", "band_ord", "low", "high", "genders", "age_min", "age_max")
    fits = (F.size(F.coalesce("genders", F.array().cast("array<string>"))) == 0) | F.array_contains("genders", normal_gender(F.col("gender")))
    fits = F.coalesce(fits & (F.col("age_min").isNull() | (F.col("age") >= F.col("age_min"))) & (F.col("age_max").isNull() | (F.col("age") <= F.col("age_max"))), F.lit(False))
    joined = of.join(about, "patient_id", "left").join(table, "name", "left").withColumn("fits", fits)
    chosen = first_of(joined, ["patient_id", "key"], [F.col("fits").desc(), F.col("band_ord").asc_nulls_last()])
    number = F.col("value").try_cast("double")
    found = F.when(F.col("kind") == "context", "informational").when(F.col("kind").isNull() | number.isNull(), "unknown").otherwise(status(number, F.col("low"), F.col("high"), F.col("direction")))
    return chosen.select("patient_id", "key", "value", "label", "unit", number.alias("number"), "low", "high", found.alias("status"))


def summary(findings: DataFrame) -> DataFrame:
    """Per patient: the keys of each kind of finding, in order of their names, and the labels that matter: abnormal ones, or else the first three recognised."""
    keys = lambda *kinds: F.sort_array(F.collect_list(F.when(F.col("status").isin(*kinds), F.col("key"))))
    labels = lambda *kinds: F.transform(F.sort_array(F.collect_list(F.when(F.col("status").isin(*kinds), F.struct("key", "label")))), lambda x: x["label"])
    out = findings.groupBy("patient_id").agg(keys("low", "high").alias("abnormal"), keys("informational").alias("informational"), keys("unknown").alias("unknown"), labels("low", "high").alias("bad"), F.slice(labels("low", "high", "normal", "informational"), 1, 3).alias("some"))
    return out.select("patient_id", "abnormal", "informational", "unknown", F.when(F.size("bad") > 0, F.col("bad")).otherwise(F.col("some")).alias("relevant_terms"))


# To which group a finding belongs; the first one that has its key.
CLUSTERS = {
    "HF severity and congestion": "bnp nt_pro_bnp ef lvef nyha edema rales orthopnea jugularvein_01 hepatomegaly",
    "Cardio-renal and electrolyte safety": "crea creatinine urea bun egfr cysc cystatin_c potassium sodium kidney_disease",
    "Rhythm and conduction": "heartrate heart_rate pulse qrs qrsduur afib_bl bundeltakblok pm_rhythm_ecg pacemaker_bl sbp dbp bpsyst bpdiast",
    "Anemia and iron status": "ferritin hemoglobin hb haemoglobin hematocrit haematocrit transferrin",
    "Inflammation and injury": "crp hscrp hs_crp il6 il_6 c_reactive_protein hstnt hs_tnt troponin",
    "Glycemic and cardiometabolic risk": "glucose hba1c cholesterol chol ldl hdl triglycerides diabetes",
    "Volume and nutritional context": "bmi weight",
}
BY_LABEL = {"Cardio-renal and electrolyte safety": "creatin", "Inflammation and injury": "reactive protein"}


def cluster(key: Column, label: Column) -> Column:
    """The group of a finding by its key, or by a word of its label."""
    out = F.lit("Other findings")
    for name, keys in reversed(CLUSTERS.items()):
        fits = F.lower(key).isin(keys.split())
        if name in BY_LABEL:
            fits = fits | F.contains(F.lower(F.coalesce(label, F.lit(""))), F.lit(BY_LABEL[name]))
        out = F.when(fits, name).otherwise(out)
    return out


# Keys that speak for a field.
CARDIAC = "bnp nt_pro_bnp ef lvef nyha edema rales orthopnea jugularvein_01 hepatomegaly qrsduur heart_rate heartrate bpsyst bpdiast sbp dbp afib_bl bundeltakblok pm_rhythm_ecg pacemaker_bl valvhd ischaemic hist_mi cabg angina01 dosebb_prev rasdose_prev dosespiro_prev loop_dose_prev sglt2dose_prev arnidose_prev potassium sodium crea creatinine urea cysc cystatin_c hstnt hscrp hs_crp crp il6 il_6"
GLYCEMIC = "glucose hba1c diabetes"
RENAL = "crea creatinine urea cysc cystatin_c kidney_disease potassium sodium"


def specialty(keys: Column, heart_failure_context: Column) -> Column:
    """heart_failure, metabolic, renal or general, by how many of a patient's distinct keys speak for each; contexts about heart failure count as three."""
    n = lambda names: F.size(F.array_intersect(keys, F.array(*map(F.lit, names.split()))))
    cardiac = n(CARDIAC) + F.when(heart_failure_context, 3).otherwise(0)
    return F.when(cardiac >= F.greatest(n(GLYCEMIC) + 1, n(RENAL), F.lit(2)), "heart_failure").when(n(GLYCEMIC) >= 2, "metabolic").when(n(RENAL) >= 2, "renal").otherwise("general")


# Clusters in the order in which heart failure looks at them; words of contexts about it.
HEART_FAILURE_ORDER = ["HF severity and congestion", "Cardio-renal and electrolyte safety", "Rhythm and conduction", "Anemia and iron status", "Inflammation and injury", "Glycemic and cardiometabolic risk"]
HEART_FAILURE_WORDS = "heart failure|hfr ef|hfref|hfmr ef|hfpef|congestion|decongestion|gdmt|euvolaemia|euvolemia|hyperkalaemia|hyperkalemia|hyponatraemia|hyponatremia|raas|ace-i|arb|arni|mra|sglt2|diuretic|ivabradine|nt-probnp|bnp".split("|")
#: Keys that a context also speaks for if it has one of the words.
ALSO_SAID = [
    ("potassium sodium creatinine crea", ["renal function", "hyperkalaemia", "hyperkalemia", "hyponatraemia", "hyponatremia"]),
    ("bnp nt_pro_bnp ef lvef", ["heart failure"]),
    ("qrsduur afib_bl", ["rhythm", "atrial fibrillation", "qrs"]),
]
# What is missing of a heart-failure, a metabolic and any other profile without any of the keys.
MISSING = {
    "heart_failure": [
        ("current symptoms or functional status", "symptoms nyha orthopnea edema rales angina01"),
        ("blood pressure or hypotension tolerance", "blood_pressure sbp dbp bpsyst bpdiast"),
        ("congestion or volume status", "volume_status edema orthopnea rales jugularvein_01 hepatomegaly weight"),
        ("active HF medications or recent dose changes", "medication_history dosebb_prev rasdose_prev dosespiro_prev loop_dose_prev sglt2dose_prev arnidose_prev"),
    ],
    "metabolic": [
        ("current symptoms", "symptoms"),
        ("diabetes history", "diabetes_history"),
        ("glucose-lowering medication history", "medication_history"),
        ("fasting versus random sampling context", "fasting_status"),
        ("prior HbA1c or glucose trends", "prior_hba1c prior_results"),
    ],
    "other": [
        ("current symptoms", "symptoms"),
        ("medication history", "medication_history"),
        ("prior laboratory trends", "prior_results"),
        ("working diagnosis or clinical context", "diagnosis"),
    ],
}


def has_any(text: Column, words: list[str]) -> Column:
    """Does a text have one of the words anywhere?"""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def said_for(text: Column, key: Column, label: Column) -> Column:
    """Does a context, in lower case, speak for a finding: by its key, its label or a word that stands for the key?"""
    out = F.contains(text, F.lower(key)) | F.contains(text, F.lower(F.coalesce(label, key)))
    for keys, said in ALSO_SAID:
        out = out | (F.lower(key).isin(keys.split()) & has_any(text, said))
    return out


def prioritised(clusters: Column, is_heart_failure: Column, limit: int = 2) -> Column:
    """The first `limit` of a patient's clusters: heart failure has an order of its own, with other clusters behind."""
    ordered = F.array_intersect(F.array(*map(F.lit, HEART_FAILURE_ORDER)), clusters)
    return F.slice(F.when(is_heart_failure, F.array_union(ordered, clusters)).otherwise(clusters), 1, limit)


def missing_details(keys: Column, specialty_name: Column, clusters: Column, abnormal_keys: Column) -> Column:
    """What a patient's variables lack, in a fixed order, by specialty."""
    low = F.transform(keys, F.lower)
    lacks = lambda names: ~F.arrays_overlap(low, F.array(*map(F.lit, names.split())))
    told = lambda rows: F.array(*(F.when(lacks(names), text) for text, names in rows))
    heart = F.concat(
        told(MISSING["heart_failure"]),
        F.array(F.when(F.array_contains(clusters, HEART_FAILURE_ORDER[1]) & lacks("baseline_creatinine prior_results prior_creatinine prior_egfr"), "baseline renal function or recent laboratory trends")),
        F.array(F.when(F.arrays_overlap(abnormal_keys, F.array(F.lit("ef"), F.lit("lvef"))) & lacks("prior_ef"), "prior EF")),
    )
    return F.array_compact(F.when(specialty_name == "heart_failure", heart).when(specialty_name == "metabolic", told(MISSING["metabolic"])).otherwise(told(MISSING["other"])))


def told_finding(label: Column, value: Column, unit: Column, status_: Column, low: Column, high: Column, description: Column | None = None) -> Column:
    """One line on a finding: its value, and where that lies against the reference."""
    shown = F.concat(label, F.lit("="), value, F.coalesce(F.concat(F.lit(" "), F.nullif(unit, F.lit(""))), F.lit("")))
    bounds = F.concat_ws(" to ", low.cast("string"), high.cast("string"))
    bounds = F.when((bounds != "") & (F.coalesce(unit, F.lit("")) != ""), F.concat(bounds, F.lit(" "), unit)).otherwise(bounds)
    if description is not None:
        bounds = F.when(F.coalesce(description, F.lit("")) == "", bounds).when(bounds == "", description).otherwise(F.concat(bounds, F.lit(" ("), description, F.lit(")")))
    where = F.when(status_ == "normal", "within").when(status_ == "low", "below").when(status_ == "high", "above")
    placed = F.concat(shown, F.lit(" is "), where, F.lit(" the configured reference"), F.when(bounds == "", "").otherwise(F.concat(F.lit(" ("), bounds, F.lit(")"))), F.lit("."))
    return F.when(status_ == "informational", F.concat(shown, F.lit(" was recorded for context."))).when(where.isNull(), F.concat(shown, F.lit(" could not be interpreted against the configured reference."))).otherwise(placed)


def portrait(findings: DataFrame) -> DataFrame:
    """One row per patient of profile()'s rows: all keys; recognised keys; abnormal findings (key, label, value, unit, status, cluster), by key; clusters in order of their first finding; relevant_terms.

    A patient has as many findings as markers at most, so the arrays are short.
    """
    at = F.struct("key", normal_key(F.col("key")).alias("name"), "label", "value", "unit", "status", cluster(normal_key(F.col("key")), F.col("label")).alias("cluster"), "low", "high")
    every = F.sort_array(F.collect_list(at))
    rows = findings.groupBy("patient_id").agg(every.alias("every"))
    known = F.filter("every", lambda x: x["status"] != "unknown")
    bad = F.filter("every", lambda x: x["status"].isin("low", "high"))
    rows = rows.select("patient_id", F.transform("every", lambda x: x["key"]).alias("keys"), known.alias("known"), bad.alias("abnormal"))
    terms = F.transform(F.when(F.size("abnormal") > 0, F.col("abnormal")).otherwise(F.slice("known", 1, 3)), lambda x: x["label"])
    return rows.select("patient_id", "keys", F.transform("known", lambda x: x["name"]).alias("recognised"), "abnormal", F.array_distinct(F.transform("abnormal", lambda x: x["cluster"])).alias("clusters"), terms.alias("relevant_terms"), "known")
