"""Dose texts, near-threshold rules, and the choice of recommendations to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import dealt, first_of, top

#: How near to a threshold a value counts as near.
MARGINS = {"potassium": 0.2, "creatinine": 0.3, "egfr": 5.0, "sbp": 0.0}
#: Actions that are shown, in their order.
SHOWN = ("switch", "start", "increase")


def number(value: Column) -> Column:
    """The leading number of a dose: `24/26 mg` is 24, a comma is a decimal point; null for anything else."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"\s*mg\b", "")
    text = F.replace(F.trim(F.split_part(text, F.lit("/"), F.lit(1))), F.lit(","), F.lit("."))
    out = F.nullif(text, F.lit("")).try_cast("double")
    return F.when(~F.isnan(out), out)


def snapshot(variables: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per patient with a column per field: the value of its first alias that the patient has.

    variables (patient_id, key, value), aliases (alias, field, priority): keys are compared without case. A first alias whose
    value is null leaves the field null. Aliases are a list of names, which goes to all tasks, whatever size Spark takes it for.
    """
    joined = variables.withColumn("alias", F.lower(F.trim("key"))).join(F.broadcast(aliases.withColumn("alias", F.lower("alias"))), "alias")
    chosen = first_of(joined, ["patient_id", "field"], [F.col("priority"), F.col("key")])
    return chosen.groupBy("patient_id").pivot("field").agg(F.first("value"))


def near_upper(value: Column, caution: Column, stop: Column, margin: float) -> Column:
    """At or above the lower one of the two thresholds less the margin; false without value or thresholds."""
    return F.coalesce(value >= F.least(caution, stop) - margin, F.lit(False))


def near_lower(value: Column, caution: Column, stop: Column, margin: float) -> Column:
    return F.coalesce(value <= F.greatest(caution, stop) + margin, F.lit(False))


def visible(recommendations: DataFrame, priorities: DataFrame, limit: int = 3) -> DataFrame:
    """The recommendations to show per request: eligible and grounded ones with an action to take, by action, priority of the family and name.

    recommendations (request_id, family, drug, action, eligible, grounded; wants_arni if there), priorities (family, priority).
    With wants_arni, the request takes or asks for an ARNI: then the RAS family, which must not go with it, is left out; else
    an ARNI is shown only as a start. A loop diuretic that may be shown is among these anyway, so there is nothing to fall back on.
    """
    action = F.array_position(F.array(*map(F.lit, SHOWN)), F.col("action"))
    kept = recommendations.where(F.col("eligible") & F.col("grounded") & F.col("action").isin(*SHOWN)).join(F.broadcast(priorities), "family", "left")
    if "wants_arni" in recommendations.columns:
        wants = F.coalesce("wants_arni", F.lit(False))
        kept = kept.where(~((F.col("family") == "ras") & wants) & ((F.col("family") != "arni") | wants | (F.col("action") == "start")))
    return top(kept, ["request_id"], [action, F.col("priority").asc_nulls_last(), F.col("drug")], limit).drop("priority")


_NUMBER = r"(\d+(?:\.\d+)?)"


def agent_line(contexts: DataFrame, agents: DataFrame) -> DataFrame:
    """(request_id, agent, line): the first line of a request's contexts (request_id, ord, snippet) that names the agent; if none does, all snippets."""
    cut = contexts.select("request_id", "ord", F.posexplode(F.split("snippet", r"\r?\n", -1)).alias("at", "line"))
    met = cut.join(dealt(agents), "request_id").where(F.contains(F.lower("line"), F.replace(F.lower("agent"), F.lit("_"), F.lit(" "))))
    first = met.groupBy("request_id", "agent").agg(F.trim(F.min_by("line", F.struct("ord", "at"))).alias("line"))
    every = contexts.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "snippet"))), lambda x: x["snippet"]), "\n").alias("all"))
    return agents.join(dealt(first), ["request_id", "agent"], "left").join(dealt(every), "request_id", "left").select("request_id", "agent", F.coalesce("line", "all", F.lit("")).alias("line"))


def shown_number(value: Column) -> Column:
    """Three decimals at most, whole numbers without any."""
    short = F.round(value, 3)
    return F.when(short == F.floor(short), F.floor(short).cast("string")).otherwise(short.cast("string"))


def labelled_dose(line: Column, label: str) -> Column:
    """(text, value, frequency) of `label 5 mg o.d.`; fields are null where the line has none."""
    pattern = rf"(?i){label}\s+{_NUMBER}\s*mg\s*([a-z.]+)"
    value, times = F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast("double"), F.lower(F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")))
    return F.struct(F.concat(shown_number(value), F.lit(" mg "), times).alias("text"), value.alias("value"), times.alias("frequency"))


def target_dose(line: Column) -> Column:
    """(text, value, frequency) of `target dose 5 mg` or of a range, whose larger end is the value."""
    pattern = rf"(?i)target dose\s+{_NUMBER}(?:\s*[–-]\s*{_NUMBER})?\s*mg\s*([a-z.]+)"
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    low = part(1).try_cast("double")
    high, times = F.coalesce(part(2).try_cast("double"), low), F.lower(part(3))
    text = F.when(low == high, shown_number(low)).otherwise(F.concat(shown_number(low), F.lit("-"), shown_number(high)))
    return F.struct(F.concat(text, F.lit(" mg "), times).alias("text"), F.greatest(low, high).alias("value"), times.alias("frequency"))


def combined_dose(line: Column, label: str) -> Column:
    """(text, value, frequency) of `label 24/26 mg b.i.d.`; the value is the leading number."""
    pattern = rf"(?i){label}\s+(\d+)/(\d+)\s*mg\s*([a-z.]+)"
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    return F.struct(F.concat(part(1), F.lit("/"), part(2), F.lit(" mg "), F.lower(part(3))).alias("text"), part(1).try_cast("double").alias("value"), F.lower(part(3)).alias("frequency"))


def dose_range(line: Column, label: str) -> Column:
    """(text, low, high) of `label 20-40 mg`, taken daily."""
    pattern = rf"(?i){label}\s*{_NUMBER}\s*[–-]?\s*{_NUMBER}?\s*mg"
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).try_cast("double")
    low = part(1)
    high = F.coalesce(part(2), low)
    text = F.when(low == high, shown_number(low)).otherwise(F.concat(shown_number(low), F.lit("-"), shown_number(high)))
    return F.struct(F.concat(text, F.lit(" mg daily")).alias("text"), low.alias("low"), high.alias("high"))


def crossed(potassium: Column, creatinine: Column, egfr: Column, over_potassium: Column, over_creatinine: Column, under_egfr: Column) -> Column:
    """Is any threshold crossed? Missing values and thresholds never are."""
    return F.coalesce(potassium > over_potassium, F.lit(False)) | F.coalesce(creatinine > over_creatinine, F.lit(False)) | F.coalesce(egfr < under_egfr, F.lit(False))


def mra_actions(patients: DataFrame) -> DataFrame:
    """patients with action, dose and status of the MRA family, by an ordered list of rules.

    Columns read: potassium, creatinine, egfr, current (the dose taken, null or 0: none), start_dose, target_dose (texts),
    target_value, grounded, and thresholds stop_/caution_ with potassium, creatinine, egfr.
    """
    c = F.col
    stop = crossed(c("potassium"), c("creatinine"), c("egfr"), *(c(f"stop_{n}") for n in ("potassium", "creatinine", "egfr")))
    care = crossed(c("potassium"), c("creatinine"), c("egfr"), *(c(f"caution_{n}") for n in ("potassium", "creatinine", "egfr")))
    for name in ("potassium", "creatinine"):
        care = care | near_upper(c(name), c(f"caution_{name}"), c(f"stop_{name}"), MARGINS[name])
    care = care | near_lower(c("egfr"), c("caution_egfr"), c("stop_egfr"), MARGINS["egfr"])
    taken = F.coalesce(c("current") != 0, F.lit(False))
    known = F.coalesce(c("grounded"), F.lit(False)) & c("start_dose").isNotNull()
    below = F.coalesce(c("current") + 0.001 < c("target_value"), F.lit(False))
    best = F.coalesce("target_dose", "start_dose")
    rules = [
        (~known, "not_grounded", None, "ungrounded"),
        (stop & taken, "stop", None, "contraindicated"),
        (stop, "avoid_start", None, "contraindicated"),
        (care & taken, "reduce", c("start_dose"), "caution"),
        (care, "avoid_start", None, "caution"),
        (~taken, "start", c("start_dose"), "eligible"),
        (below, "increase", best, "eligible"),
        (F.lit(True), "maintain", best, "at_target"),
    ]
    out = F.lit(None).cast("struct<action:string,dose:string,status:string>")
    for cond, action, dose, state in reversed(rules):
        out = F.when(cond, F.struct(F.lit(action).alias("action"), (F.lit(None).cast("string") if dose is None else dose).alias("dose"), F.lit(state).alias("status"))).otherwise(out)
    return patients.withColumn("_mra", out).select(*patients.columns, "_mra.*")


def cautions(recommendations: DataFrame) -> DataFrame:
    """Per request: recommendations that are contraindicated or need care, in order of their families, and the agents that were assumed."""
    careful = F.col("status").isin("contraindicated", "caution") & F.col("note").isNotNull()
    return recommendations.groupBy("request_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(careful, F.struct("family", "drug", "note")))), lambda x: F.concat(x["drug"], F.lit(": "), x["note"])).alias("cautions"),
        F.array_sort(F.collect_set(F.when(F.col("assumed"), F.col("drug")))).alias("assumed_agents"),
    )


def grounded_contexts(contexts: DataFrame, evidence: DataFrame, most: int = 12) -> DataFrame:
    """The contexts (request_id, ord, chunk_id) that evidence (request_id, at, chunk_id) names, in its order, at most `most`; for a request without any, its first ones."""
    at = evidence.groupBy("request_id", "chunk_id").agg(F.min("at").alias("_at"))
    marked = contexts.join(dealt(at), ["request_id", "chunk_id"], "left")
    named = F.max(F.col("_at").isNotNull()).over(Window.partitionBy("request_id"))
    kept = marked.withColumn("_named", named).where(F.col("_at").isNotNull() | ~F.col("_named"))
    return top(kept, ["request_id"], [F.col("_at").asc_nulls_last(), F.col("ord")], most).drop("_at", "_named")


# The families in their order, their keywords, and the agents that are assumed.
FAMILIES = ["mra", "beta_blocker", "ras", "arni", "sglt2", "loop_diuretic"]
PRIORITY = {"sglt2": 0, "beta_blocker": 1, "arni": 2, "ras": 3, "mra": 4, "loop_diuretic": 5}
KEYWORDS = {
    "mra": ["mra", "spironolactone", "eplerenone"],
    "beta_blocker": ["beta-blocker", "beta blocker", "bisoprolol", "carvedilol", "metoprolol", "nebivolol"],
    "ras": ["ace-i", "ace i", "arb", "enalapril", "lisinopril", "ramipril", "trandolapril", "captopril"],
    "arni": ["arni", "sacubitril", "valsartan", "sac/val"],
    "sglt2": ["sglt2", "dapagliflozin", "empagliflozin"],
    "loop_diuretic": ["diuretic", "loop diuretic", "furosemide", "bumetanide", "torasemide", "congestion"],
}
AGENTS = {"mra": "spironolactone", "beta_blocker": "bisoprolol", "ras": "enalapril", "arni": "sacubitril/valsartan", "sglt2": "dapagliflozin", "loop_diuretic": "furosemide"}
# Other names of agents; those that only name a family stand for its default.
AGENT_NAMES = {
    "metoprolol": "metoprolol_succinate",
    "metoprolol_cr_xl": "metoprolol_succinate",
    "metoprolol_succinate_(cr/xl)": "metoprolol_succinate",
    "sacubitril_valsartan": "sacubitril/valsartan",
    "sac_val": "sacubitril/valsartan",
    "spironolacton": "spironolactone",
}
FAMILY_NAMES = ("mra", "bb", "loop")
# What a family's contexts have to say (all parts of a line) for a threshold; of several lines the last one holds.
THRESHOLDS = {
    "mra": [
        (["k", ">5.0"], "caution_potassium", 5.0), (["k", "above 5.5"], "stop_potassium", 5.5), (["k", ">6.0"], "stop_potassium", 6.0),
        (["2.5 mg/dl"], "caution_creatinine", 2.5), (["3.5 mg/dl"], "stop_creatinine", 3.5), (["egfr <30"], "caution_egfr", 30.0), (["egfr <20"], "stop_egfr", 20.0),
    ],
    "beta_blocker": [(["heart rate <50"], "caution_hr", 50.0), (["if <50 b.p.m."], "caution_hr", 50.0), (["sbp <90"], "caution_sbp", 90.0)],
    "ras": [
        (["significant hyperkalaemia (k", ">5.0"], "caution_potassium", 5.0), (["k", ">5.5 mmol/l"], "stop_potassium", 5.5), (["2.5 mg/dl"], "caution_creatinine", 2.5),
        (["3 mg/dl"], "stop_creatinine", 3.0), (["3.5 mg/dl"], "stop_creatinine", 3.5), (["egfr <30"], "caution_egfr", 30.0), (["egfr <25"], "stop_egfr", 25.0), (["egfr <20"], "stop_egfr", 20.0), (["sbp <90"], "caution_sbp", 90.0),
    ],
    "arni": [([">5.0"], "caution_potassium", 5.0), ([">5.5 mmol/l"], "stop_potassium", 5.5), (["egfr <30"], "stop_egfr", 30.0), (["sbp <90"], "caution_sbp", 90.0), (["sbp >95"], "caution_sbp", 90.0)],
    "sglt2": [(["egfr <20"], "stop_egfr", 20.0), (["sbp <95"], "caution_sbp", 95.0)],
    "loop_diuretic": [(["egfr <30"], "caution_egfr", 30.0), (["2.5 mg/dl"], "caution_creatinine", 2.5), (["sbp <90"], "caution_sbp", 90.0)],
}
BOUNDS = ["caution_potassium", "stop_potassium", "caution_creatinine", "stop_creatinine", "caution_egfr", "stop_egfr", "caution_sbp", "caution_hr"]
# Phrases for a dose that may be doubled, for a start only without congestion, and for a pause before a switch.
DOUBLES, WASHOUT = "double the dose", "36 h"
EUVOLAEMIA = {"beta_blocker": ["achieve ‘euvolaemia’ before starting", "achieve 'euvolaemia' before starting", "relieve congestion and achieve"], "loop_diuretic": ["not indicated if the patient has never had symptoms or signs of congestion"]}


def agent(value: Column, family: Column) -> Column:
    """(name, assumed): the usual name of a patient's agent, or the family's default."""
    name = F.replace(F.replace(F.lower(F.trim(value)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    default = F.element_at(F.create_map(*(F.lit(x) for pair in AGENTS.items() for x in pair)), family)
    for other, usual in AGENT_NAMES.items():
        name = F.when(name == other, usual).otherwise(name)
    known = F.nullif(F.when(name.isin(*FAMILY_NAMES), default).otherwise(name), F.lit(""))
    return F.struct(F.coalesce(known, default).alias("name"), known.isNull().alias("assumed"))


def family_queries(patients: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(request_id, family, ord, query) of patients (request_id, and a column family_agent per family, if there): each family's template with the agent in it."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(i).alias("ord"), F.replace(F.lit(templates[f]), F.lit("{agent}"), agent(F.col(f"{f}_agent") if f"{f}_agent" in patients.columns else F.lit(None).cast("string"), F.lit(f))["name"]).alias("query")) for i, f in enumerate(FAMILIES) if templates.get(f)]
    return patients.select("request_id", F.explode(F.array(*rows)).alias("x")).select("request_id", "x.*")


def by_family(contexts: DataFrame) -> DataFrame:
    """contexts (request_id, ord, title, snippet, ...) with `family`, once for each family of which they have a keyword."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit(""))))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return contexts.withColumn("family", F.explode(F.array_compact(F.array(*(F.when(any_of(words), f) for f, words in KEYWORDS.items())))))


def _reduced_combo(text: Column) -> Column:
    """(text, value) of the smaller first dose of the combination."""
    chosen, named = F.regexp_extract(text, r"(?i)(24/26\s*mg\s*[a-z.]+)\s+in selected patients", 1), F.regexp_extract(text, r"(?i)reduced starting dose\s*\(?24/26\s*mg\s*([a-z.]+)\)?", 1)
    dose = F.when(chosen != "", F.replace(F.lower(chosen), F.lit("  "), F.lit(" "))).when(named != "", F.concat(F.lit("24/26 mg "), F.lower(named)))
    return F.struct(dose.alias("text"), F.when(dose.isNotNull(), 24.0).alias("value"))


def evidence(patients: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per request and family: what the family's contexts say on doses and thresholds.

    patients (request_id, and a column family_agent per family, if there); contexts (request_id, ord, family, chunk_id,
    page_number, title, snippet), a few of each request. Columns: drug, assumed, chunk_ids, pages, start_dose, start_value,
    frequency, target_dose, target_value, reduced_dose, reduced_value, start_high, usual_range, BOUNDS, doubles, needs_euvolaemia, washout.
    """
    agents = F.array(*(F.struct(F.lit(f).alias("family"), agent(F.col(f"{f}_agent") if f"{f}_agent" in patients.columns else F.lit(None).cast("string"), F.lit(f)).alias("agent")) for f in FAMILIES))
    rows = patients.select("request_id", F.explode(agents).alias("x")).select("request_id", "x.family", F.col("x.agent.name").alias("drug"), F.col("x.agent.assumed").alias("assumed"))
    item = F.struct("ord", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.col("chunk_id").cast("string").alias("chunk_id"), "page_number")
    rows = rows.join(dealt(contexts.groupBy("request_id", "family").agg(F.sort_array(F.collect_list(item)).alias("items"))), ["request_id", "family"], "left")
    rows = rows.withColumn("text", F.coalesce(F.array_join(F.transform("items", lambda x: F.lower(F.concat(x["title"], F.lit(" "), x["snippet"]))), "\n"), F.lit("")))
    wanted = F.replace(F.lower("drug"), F.lit("_"), F.lit(" "))
    lines = F.flatten(F.transform("items", lambda x: F.split(x["snippet"], r"\r?\n", -1)))
    line = F.coalesce(F.trim(F.get(F.filter(lines, lambda x: F.contains(F.lower(x), wanted)), F.lit(0))), F.array_join(F.transform("items", lambda x: x["snippet"]), "\n"), F.lit(""))
    rows = rows.withColumn("line", line)
    of = lambda *families: F.col("family").isin(*families)
    said, combined, loop = labelled_dose(F.col("line"), "starting dose"), combined_dose(F.col("text"), "starting dose"), dose_range(F.col("line"), "starting dose")
    both = labelled_dose(F.col("line"), r"starting \(and target\) dose")
    target, wide, pair = labelled_dose(F.col("line"), "target dose"), target_dose(F.col("line")), combined_dose(F.col("text"), "target dose")
    reduced = _reduced_combo(F.col("text"))
    pick = lambda field, arni, sglt2, loop_, other: F.when(of("arni"), arni[field]).when(of("sglt2"), sglt2[field]).when(of("loop_diuretic"), loop_).otherwise(other[field])
    goal = lambda field: F.when(of("arni"), pair[field]).when(of("sglt2"), both[field]).when(of("ras"), wide[field]).when(~of("loop_diuretic"), target[field])
    has = lambda parts: F.expr("true") if not parts else [F.contains("text", F.lit(x)) for x in parts]

    def bound(name: str) -> Column:
        out = F.lit(None).cast("double")
        for family, lines_ in THRESHOLDS.items():
            for parts, to, value in lines_:
                if to == name:
                    cond = of(family)
                    for x in has(parts):
                        cond = cond & x
                    out = F.when(cond, value).otherwise(out)
        return out.alias(name)

    any_phrase = lambda family: F.array_contains(F.transform(F.array(*map(F.lit, EUVOLAEMIA[family])), lambda w: F.contains("text", w)), True) & of(family)
    return rows.select(
        "request_id", "family", "drug", "assumed",
        F.coalesce(F.array_distinct(F.filter(F.transform("items", lambda x: x["chunk_id"]), lambda x: x.isNotNull())), F.array().cast("array<string>")).alias("chunk_ids"),
        F.coalesce(F.array_distinct(F.filter(F.transform("items", lambda x: x["page_number"]), lambda x: x.isNotNull())), F.array().cast("array<int>")).alias("pages"),
        pick("text", combined, both, loop["text"], said).alias("start_dose"), pick("value", combined, both, loop["low"], said).alias("start_value"), pick("frequency", combined, both, F.lit("daily"), said).alias("frequency"),
        goal("text").alias("target_dose"), goal("value").alias("target_value"), F.when(of("arni"), reduced["text"]).alias("reduced_dose"), F.when(of("arni"), reduced["value"]).alias("reduced_value"),
        F.when(of("loop_diuretic"), loop["high"]).alias("start_high"), F.when(of("loop_diuretic"), dose_range(F.col("line"), "usual dose")["text"]).alias("usual_range"),
        *(bound(b) for b in BOUNDS),
        (F.contains("text", F.lit(DOUBLES)) & of("beta_blocker", "ras", "arni")).alias("doubles"), (any_phrase("beta_blocker") | any_phrase("loop_diuretic")).alias("needs_euvolaemia"), (F.contains("text", F.lit(WASHOUT)) & of("arni")).alias("washout"),
    )


# The notes of decisions.
NOTES = {
    "mra stop": "Retrieved MRA safety thresholds were crossed.",
    "mra reduce": "Retrieved MRA guidance supports halving or holding when potassium/renal thresholds are exceeded or close to stopping thresholds.",
    "mra avoid": "Retrieved MRA starting thresholds are not met or are too close to stopping thresholds.",
    "bb rate": "Retrieved beta-blocker guidance says to halve the dose when heart rate is below 50 b.p.m. with clinical concern.",
    "bb rate start": "Retrieved beta-blocker guidance cautions against starting when heart rate is below 50 b.p.m.",
    "bb pressure": "Retrieved beta-blocker guidance cautions against ongoing titration during hypotension.",
    "bb pressure start": "Retrieved beta-blocker guidance cautions against starting while hypotensive.",
    "bb congestion": "Retrieved beta-blocker guidance advises relieving congestion and restoring euvolaemia before starting.",
    "no interval": "No grounded uptitration interval was extracted for this agent.",
    "ras with arni": "ARNI pathway takes precedence over ACE-I/ARB co-prescription.",
    "ras stop": "Retrieved ACE-I/ARB stopping thresholds were crossed.",
    "ras stop start": "Retrieved ACE-I/ARB starting thresholds were not met.",
    "ras reduce": "Retrieved ACE-I/ARB guidance supports halving or holding when chemistry rises excessively or is close to stopping thresholds.",
    "ras avoid": "Retrieved ACE-I/ARB guidance lists potassium/renal/blood-pressure cautions for initiation.",
    "arni potassium": "Retrieved ARNI stopping threshold for potassium was crossed.",
    "arni potassium start": "Retrieved ARNI starting threshold for potassium was not met.",
    "arni egfr": "Retrieved ARNI stopping threshold for eGFR was crossed.",
    "arni egfr start": "Retrieved ARNI starting threshold for eGFR was not met.",
    "arni pressure": "Retrieved ARNI guidance cautions against hypotension.",
    "arni pressure start": "Retrieved ARNI guidance cautions against starting while hypotensive.",
    "arni near": "Retrieved ARNI guidance lists potassium/renal thresholds that are too close to stopping thresholds for escalation.",
    "arni near start": "Retrieved ARNI guidance lists potassium/renal thresholds that are too close to stopping thresholds for initiation.",
    "arni washout": "Requires ACE-I washout of at least 36 hours before switching.",
    "sglt2 egfr": "Retrieved SGLT2 eGFR threshold was not met.",
    "sglt2 pressure": "Retrieved SGLT2 blood-pressure threshold was not met.",
    "sglt2 fluid": "Monitor fluid balance because SGLT2 inhibitors may intensify diuresis when combined with diuretics.",
    "loop reduce": "Retrieved diuretic guidance supports reducing the dose in hypovolaemia or hypotension without congestion.",
    "loop avoid": "Retrieved diuretic guidance does not support initiation without congestion or during volume depletion.",
    "loop none": "Retrieved diuretic guidance says loop diuretics are not indicated without symptoms or signs of congestion.",
    "loop keep": "Retrieved diuretic guidance emphasizes titrating to congestion and volume status rather than a fixed target.",
    "ungrounded": "No retrieved guideline evidence was available for this drug family.",
}
DOSES = {"mra": "dose_mra_prev", "beta_blocker": "dose_bb_prev", "ras": "dose_ras_prev", "arni": "dose_arni_prev", "sglt2": "dose_sglt2_prev", "loop_diuretic": "dose_loop_prev"}


def recommended(patients: DataFrame, known: DataFrame) -> DataFrame:
    """One row per request and family of evidence(): drug, action, dose, status, note, assumed, grounded, eligible, chunk_ids, pages, wants_arni.

    patients (request_id; numbers potassium, creatinine, egfr, sbp, heart_rate, weight_gain_kg; booleans congestion_present,
    volume_depleted, switch_to_arni; texts DOSES), any of which may be null. Each family has an ordered list of rules, of
    which the first that holds decides; missing values and thresholds hold in none.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    r = known.join(dealt(patients), "request_id")
    c = F.col
    previous = F.element_at(F.create_map(*(x for f, d in DOSES.items() for x in (F.lit(f), c(d).cast("string")))), c("family"))
    r = r.withColumn("taken", number(previous))
    lead = F.coalesce(F.nullif(F.regexp_extract(c("dose_arni_prev").cast("string"), rf"{_NUMBER}/{_NUMBER}", 1), F.lit("")).try_cast("double"), number(c("dose_arni_prev").cast("string")))
    taking = lambda d: yes((F.trim(c(d).cast("string")) != "") & (F.coalesce(number(c(d).cast("string")), F.lit(1.0)) != 0))
    above, below = lambda v, b: yes(c(v) > c(b)), lambda v, b: yes(c(v) < c(b))
    current = c("taken")
    # What rules share is computed once per row, as columns.
    stop = above("potassium", "stop_potassium") | above("creatinine", "stop_creatinine") | below("egfr", "stop_egfr")
    care = above("potassium", "caution_potassium") | above("creatinine", "caution_creatinine") | below("egfr", "caution_egfr")
    near_k, near_e = near_upper(c("potassium"), c("caution_potassium"), c("stop_potassium"), MARGINS["potassium"]), near_lower(c("egfr"), c("caution_egfr"), c("stop_egfr"), MARGINS["egfr"])
    near_c = near_upper(c("creatinine"), c("caution_creatinine"), c("stop_creatinine"), MARGINS["creatinine"])
    target = F.nullif(c("target_value"), F.lit(0.0))
    dose_of = lambda value: F.concat(shown_number(value), F.lit(" mg"), F.coalesce(F.concat(F.lit(" "), F.nullif(c("frequency"), F.lit(""))), F.lit("")))
    arni_now = taking("dose_arni_prev")
    same = lambda v: yes(F.abs(lead - c(v)) < 0.01)
    r = r.withColumns({
        "_on": yes(current != 0), "_stop": stop, "_care": care | near_k | near_c | near_e, "_near": near_k | near_e, "_low": below("sbp", "caution_sbp"), "_slow": below("heart_rate", "caution_hr"),
        "_potassium": above("potassium", "stop_potassium"), "_egfr": below("egfr", "stop_egfr"),
        "_half": dose_of(F.greatest(current / 2, F.coalesce("start_value", current / 2))), "_same": dose_of(current), "_more": dose_of(F.least(current * 2, F.coalesce(target, current * 2))),
        "_at_goal": yes(current + 0.001 >= target), "_below_goal": yes(current + 0.001 < target), "_goal": F.coalesce("target_dose", "start_dose"),
        "_congested": yes(c("congestion_present")) | (yes(c("weight_gain_kg") > 1.5) & (c("family") == "loop_diuretic")), "_wants": arni_now | yes(c("switch_to_arni")), "_lead": lead, "_ras_now": taking("dose_ras_prev"), "_sglt2_now": taking("dose_sglt2_prev"),
        "_matched": F.when(same("reduced_value"), c("reduced_dose")).when(same("start_value"), c("start_dose")).when(same("target_value"), c("target_dose")),
        "_next": F.when(same("reduced_value"), c("start_dose")).when(same("start_value"), c("target_dose")).when(lead >= F.coalesce("start_value", lead), c("target_dose")).otherwise(c("start_dose")),
        "_first": F.when((yes(c("sbp").between(100, 110)) | yes(c("egfr").between(30, 60))) & c("reduced_dose").isNotNull(), c("reduced_dose")).otherwise(c("start_dose")),
    })
    on, stop, care, near, low_pressure, slow, congested = (c(f"_{n}") for n in ("on", "stop", "care", "near", "low", "slow", "congested"))
    half, at_goal, more, goal, matched, wants, ras_now = (c(f"_{n}") for n in ("half", "at_goal", "more", "goal", "matched", "wants", "ras_now"))
    had, dry, tight = c("_lead").isNotNull(), yes(c("volume_depleted")) | (c("_low") & ~c("_congested")), yes(c("sbp") <= c("caution_sbp"))
    titrated = [
        (~on, "start", c("start_dose"), "eligible", None),
        (at_goal, "maintain", c("_same"), "at_target", None),
        (c("doubles"), "increase", more, "eligible", None),
        (F.lit(True), "maintain", c("_same"), "caution", "no interval"),
    ]
    rules = {
        "mra": [
            (stop & on, "stop", None, "contraindicated", "mra stop"),
            (stop, "avoid_start", None, "contraindicated", "mra stop"),
            (care & on, "reduce", c("start_dose"), "caution", "mra reduce"),
            (care, "avoid_start", None, "caution", "mra avoid"),
            (~on, "start", c("start_dose"), "eligible", None),
            (c("_below_goal"), "increase", goal, "eligible", None),
            (F.lit(True), "maintain", goal, "at_target", None),
        ],
        "beta_blocker": [
            (slow & on, "reduce", half, "caution", "bb rate"),
            (slow, "avoid_start", None, "caution", "bb rate start"),
            (low_pressure & on, "reduce", half, "caution", "bb pressure"),
            (low_pressure, "avoid_start", None, "caution", "bb pressure start"),
            (~on & c("needs_euvolaemia") & congested, "defer_start", None, "caution", "bb congestion"),
            *titrated,
        ],
        "ras": [
            (stop & on, "stop", None, "contraindicated", "ras stop"),
            (stop, "avoid_start", None, "contraindicated", "ras stop start"),
            ((care | tight) & on, "reduce", half, "caution", "ras reduce"),
            (care | tight, "avoid_start", None, "caution", "ras avoid"),
            *titrated,
        ],
        "arni": [
            (c("_potassium") & had, "stop", None, "contraindicated", "arni potassium"),
            (c("_potassium"), "avoid_start", None, "contraindicated", "arni potassium start"),
            (c("_egfr") & had, "stop", None, "contraindicated", "arni egfr"),
            (c("_egfr"), "avoid_start", None, "contraindicated", "arni egfr start"),
            (low_pressure & had, "maintain", matched, "caution", "arni pressure"),
            (low_pressure, "avoid_start", None, "caution", "arni pressure start"),
            (near & had, "reduce", F.coalesce("reduced_dose", "start_dose", matched), "caution", "arni near"),
            (near, "avoid_start", None, "caution", "arni near start"),
            (had & yes(c("_lead") + 0.001 >= target), "maintain", F.coalesce(matched, "target_dose"), "at_target", None),
            (had, "increase", c("_next"), "eligible", None),
            (ras_now & c("washout"), "switch", c("_first"), "eligible", "arni washout"),
            (ras_now, "switch", c("_first"), "eligible", None),
            (F.lit(True), "start", c("_first"), "eligible", None),
        ],
        "sglt2": [
            (c("_egfr"), "avoid_start", None, "contraindicated", "sglt2 egfr"),
            (low_pressure, "avoid_start", None, "caution", "sglt2 pressure"),
            (c("_sglt2_now"), "maintain", c("start_dose"), "at_target", "sglt2 fluid"),
            (F.lit(True), "start", c("start_dose"), "eligible", "sglt2 fluid"),
        ],
        "loop_diuretic": [
            (dry & on, "reduce", dose_of(F.greatest(current / 2, c("start_value"))), "caution", "loop reduce"),
            (dry, "avoid_start", None, "caution", "loop avoid"),
            (~congested & ~on, "no_change", None, "not_indicated", "loop none"),
            (~on, "start", dose_of(F.when(congested, c("start_high")).otherwise(c("start_value"))), "eligible", None),
            (F.lit(True), "maintain", c("_same"), "maintain", "loop keep"),
        ],
    }

    def outcome(action, dose, state, note):
        text = lambda x: F.lit(x).cast("string")
        return F.struct(text(action).alias("action"), (text(None) if dose is None else dose).alias("dose"), text(state).alias("status"), text(NOTES.get(note)).alias("note"))

    grounded = (F.size("chunk_ids") > 0) & F.when(c("family") == "loop_diuretic", c("start_value").isNotNull()).otherwise(F.coalesce("start_dose", F.lit("")) != "")
    decision = F.when((c("family") == "ras") & wants, outcome("do_not_combine", None, "not_applicable", "ras with arni")).when(~grounded, outcome("unavailable", None, "ungrounded", "ungrounded"))
    for family, listed in rules.items():
        for cond, action, dose, state, note in listed:
            decision = decision.when((c("family") == family) & cond, outcome(action, dose, state, note))
    # A generator's columns: filters on them don't make Spark repeat the whole decision below.
    out = r.select("*", F.inline(F.array(decision)))
    known_family = c("status") != "not_applicable"
    return out.select("request_id", "family", F.when(known_family, c("drug")).alias("drug"), "action", "dose", "status", "note", (c("assumed") & known_family).alias("assumed"), (c("status") != "ungrounded").alias("grounded"), (c("status") == "eligible").alias("eligible"), "chunk_ids", "pages", c("_wants").alias("wants_arni"))


def verdicts(recommendations: DataFrame, shown: DataFrame) -> DataFrame:
    """(request_id, verdict, reasons, confidence): fail if a recommendation that is shown has no evidence."""
    careful = F.count_if(F.col("grounded") & F.col("status").isin("caution", "contraindicated"))
    per = recommendations.groupBy("request_id").agg((careful > 0).alias("careful"))
    bare = F.array_sort(F.collect_list(F.when(~F.coalesce("grounded", F.lit(False)) | (F.size("chunk_ids") == 0), F.concat(F.lit("ungrounded_recommendation:"), F.col("family")))))
    seen = shown.groupBy("request_id").agg(F.count("*").alias("n"), bare.alias("bare"))
    x = per.join(dealt(seen), "request_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fails = F.coalesce(F.size("bare"), F.lit(0)) > 0
    reasons = F.when(fails, F.col("bare")).when(F.col("n") > 0, F.array(F.lit("grounded_recommendations_with_evidence"))).when(F.col("careful"), F.array(F.lit("grounded_safety_cautions_without_visible_uptitration"))).otherwise(F.array(F.lit("no_grounded_recommendation")))
    return x.select("request_id", F.when(fails, "fail").otherwise("pass").alias("verdict"), reasons.alias("reasons"), F.when((F.col("n") == 0) & ~F.col("careful"), "medium").otherwise("high").alias("confidence"))


# What an answer says without a recommendation, and the warnings that go with answers.
NO_DOSE = "No grounded drug dose recommendation could be made from the retrieved guideline context."
WARNINGS = [
    "Drug-dosing mode now requires retrieved guideline evidence before a dose recommendation is surfaced.",
    "The answer field is intentionally short; full evidence rows and safety trade-offs are stored in metadata.drug_dosing_payload.",
]
NO_EVIDENCE = "No drug-specific evidence rows were extracted from retrieved context."
NOTHING_SHOWN = "No visible recommendation met both grounding and safety checks."
ASSUMED = "Some drug families used assumed agents because no explicit agent was supplied: "


def reports(patients: DataFrame, known: DataFrame, recommendations: DataFrame, shown: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row per request of recommended(): answer, warnings, tradeoffs, safety_cautions, and the whole payload as JSON.

    known: rows of evidence(); shown: rows of visible(); queries: rows of family_queries(). An answer has a line per shown
    recommendation, its drug (or family) and dose. A trade-off is the note of a decision that needs care or is contraindicated;
    a caution is such a decision if it is grounded, too. In the payload, families stand in their order; what is null is null there as well. A
    request has at most one row per family in any of the tables, so its lists are short.
    """
    c = F.col
    place = F.array_position(F.array(*map(F.lit, FAMILIES)), c("family"))
    careful = lambda x: x["grounded"] & x["status"].isin("caution", "contraindicated")
    note = lambda x: F.nullif(x["note"], F.lit(""))
    fields = ["drug", "action", "dose", "status", "note", "assumed", "grounded", "chunk_ids", "pages"]
    every = recommendations.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), "family", *fields))).alias("every"))
    seen = shown.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rank", "family", "drug", "dose", "action", "status", "grounded", "chunk_ids", "pages"))).alias("seen"))
    own = [f for f in known.columns if f not in ("request_id", "family")]
    used = known.where(F.size("chunk_ids") > 0).groupBy("request_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), "family", *own))), lambda x: F.struct(x["family"].alias("k"), F.struct(*(x[f].alias(f) for f in own)).alias("v")))).alias("used"))
    inputs = patients.select("request_id", F.struct(*(f for f in patients.columns if f != "request_id")).alias("inputs"))
    rows = every.join(dealt(seen), "request_id", "left").join(dealt(used), "request_id", "left").join(dealt(inputs), "request_id", "left")
    asked = F.array().cast("array<string>")
    if queries is not None:
        rows = rows.join(dealt(queries.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "query"))), lambda x: x["query"]).alias("asked"))), "request_id", "left")
        asked = F.coalesce("asked", asked)
    selected = F.coalesce("seen", F.array().cast(seen.schema["seen"].dataType))
    line = lambda x: F.concat(F.coalesce(F.nullif(x["drug"], F.lit("")), x["family"]), F.coalesce(F.concat(F.lit(": "), F.nullif(x["dose"], F.lit(""))), F.lit("")))
    agents = F.array_sort(F.array_distinct(F.transform(F.filter("every", lambda x: x["assumed"] & x["drug"].isNotNull()), lambda x: x["drug"])))
    rows = rows.withColumns({
        "answer": F.when(F.size(selected) > 0, F.array_join(F.transform(selected, line), "\n")).otherwise(NO_DOSE),
        "tradeoffs": F.transform(F.filter("every", lambda x: careful(x) & note(x).isNotNull()), lambda x: F.concat(x["family"], F.lit(": "), x["note"])),
        "safety_cautions": F.transform(F.filter("every", careful), lambda x: F.struct(*(x[f].alias(f) for f in ("family", "drug", "action", "status", "note")), x["chunk_ids"].alias("evidence_chunk_ids"))),
        "warnings": F.array_compact(F.array(*map(F.lit, WARNINGS), F.when(c("used").isNull(), NO_EVIDENCE), F.when(F.size(selected) == 0, NOTHING_SHOWN), F.when(F.size(agents) > 0, F.concat(F.lit(ASSUMED), F.array_join(agents, ", "))))),
    })
    named = lambda x, first, *more: F.struct(*(x[f].alias(f) for f in first), *(x[f].alias(n) for f, n in more))
    evidence_of = (("chunk_ids", "evidence_chunk_ids"), ("pages", "evidence_pages"))
    told = F.map_from_entries(F.transform("every", lambda x: F.struct(x["family"].alias("k"), named(x, ("family", "drug", "action"), ("dose", "recommended_dose"), ("status", "status"), ("note", "note"), ("assumed", "assumed_agent"), ("grounded", "grounded"), *evidence_of).withField("tradeoff", F.when(careful(x), x["note"])).alias("v"))))
    payload = F.struct(
        F.lit("drug_dosing_grounded").alias("mode"), told.alias("recommendations"), F.transform(selected, lambda x: named(x, ("family", "drug", "dose", "action", "status", "grounded"), *evidence_of)).alias("selected_recommendations"),
        F.coalesce("used", F.create_map().cast(used.schema["used"].dataType)).alias("evidence_rows_used"), "tradeoffs", "safety_cautions", c("inputs").alias("inputs_used"), asked.alias("retrieval_queries"),
    )
    return rows.select("request_id", "answer", "warnings", "tradeoffs", "safety_cautions", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


#: What makes contexts the same; null equals null.
_CONTEXT = ["source_id", "chunk_id", "snippet"]


def retrieved(hits: DataFrame, brought: DataFrame | None = None, top_k: int = 3, per_query: int = 3, most: int = 18) -> tuple[DataFrame, DataFrame]:
    """Contexts per family, and those of the request as a whole.

    hits (request_id, family, query_index, rank, source_id, chunk_id, title, snippet): what each family's query found, of which the first
    per_query count; brought (request_id, ord, source_id, chunk_id, title, snippet): what a request had before. A family
    has each context once (request_id, family, ord, ...). The whole is what was brought, as it is, and then what queries found in
    their order and isn't there yet, cut to the larger of top_k and most (request_id, ord, ...).
    """
    own = ["source_id", "chunk_id", "title", "snippet"]
    first = hits.where(F.col("rank") <= per_query)
    order = [F.col("query_index"), F.col("rank")]
    families = top(first_of(first, ["request_id", "family", *own], order), ["request_id", "family"], order, _NO_LIMIT, "ord").select("request_id", "family", "ord", *own)
    rows = first.select("request_id", F.struct(F.lit(1).alias("found"), F.col("query_index").cast("long").alias("a"), F.col("rank").cast("long").alias("b")).alias("place"), *own)
    if brought is not None:
        rows = rows.unionByName(brought.select("request_id", F.struct(F.lit(0).alias("found"), F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("place"), *own))
    # What was brought comes first, so a found context is the first of its kind only if none of those is the same.
    at = F.row_number().over(Window.partitionBy("request_id", *_CONTEXT).orderBy("place"))
    kept = rows.withColumn("_at", at).where("_at = 1 OR place.found = 0").drop("_at")
    return families, top(kept, ["request_id"], [F.col("place")], max(top_k, most), "ord").select("request_id", "ord", *own)


_NO_LIMIT = (1 << 31) - 1
