"""Classification of text entries by weighted word lists.

Each distinct word is searched once per text.  The words found, a short array,
then carry every decision: lists are intersected with it instead of being
matched again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import term_rules as tr
from tallyloom.functions.rules import any_hit

SYSTEMS = ["A", "B", "C", "D", "E", "0"]


@dataclass
class Rules:
    """Word lists of one classifier; replace or extend any of them."""

    systems: Mapping[str, Sequence[str]] = field(default_factory=lambda: {k: list(v) for k, v in tr.SYSTEM_WORDS.items()})
    subsystems: Mapping[str, Mapping[str, Sequence[str]]] = field(
        default_factory=lambda: {k: {c: list(w) for c, w in v.items()} for k, v in tr.SUBSYSTEM_WORDS.items()})
    polarities: Mapping[str, Sequence[str]] = field(default_factory=lambda: {k: list(v) for k, v in tr.POLARITY_WORDS.items()})
    priority: Mapping[str, int] = field(default_factory=lambda: dict(tr.PRIORITY))

    def with_word(self, system: str, word: str, subsystem: str | None = None) -> "Rules":
        """A copy that also looks for ``word``."""
        new = Rules()
        new.systems = {k: [*v, word] if k == system and subsystem is None else list(v) for k, v in self.systems.items()}
        new.subsystems = {
            k: {c: [*w, word] if c == subsystem else list(w) for c, w in v.items()} for k, v in self.subsystems.items()
        }
        new.polarities, new.priority = dict(self.polarities), dict(self.priority)
        return new

    def vocabulary(self) -> list[str]:
        lists: list[Iterable[str]] = [*self.systems.values(), *self.polarities.values()]
        for codes in self.subsystems.values():
            lists += codes.values()
        lists += [tr.DESTRUCTIVE_WORDS, tr.CONSTRUCTIVE_WORDS]
        lists += [k.split("|") for k in (*tr.DESTRUCTIVE_WEIGHTS, *tr.CONSTRUCTIVE_WEIGHTS)]
        lists += [*tr.OBJECTIVE_WORDS.values(), *tr.INFLAMMATION_WORDS.values()]
        return list(dict.fromkeys(w.lower() for words in lists for w in words))


def search_text(name: str, definition: str | None = None) -> Column:
    return F.lower(F.concat_ws(" ", name, definition) if definition else F.col(name))


def _quoted(words: Iterable[str]) -> list[str]:
    return ["'" + w.lower().replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words]


def words_found(text: str, vocabulary: Sequence[str]) -> Column:
    """Words of the list that occur in a lower-cased text column.

    ``text`` must be a column of its own (see ``with_found``), so that it is
    worked out once and not once per word.  Joining and splitting keeps the
    search inside generated code.
    """
    whens = ", ".join(f"CASE WHEN contains({text}, {w}) THEN {w} END" for w in _quoted(vocabulary))
    return F.split(F.expr(f"concat_ws('|', {whens})"), "\\|")


def with_found(rows: DataFrame, text: Column, vocabulary: Iterable[str], found: str = "_found") -> DataFrame:
    words = list(dict.fromkeys(w.lower() for w in vocabulary))
    return rows.withColumn("_text", text).withColumn(found, words_found("_text", words)).drop("_text")


def has_any(words: Iterable[str], found: str = "_found") -> Column:
    return F.expr(f"exists({found}, w -> w IN ({', '.join(_quoted(words))}))")


def how_many(words: Iterable[str], found: str = "_found") -> Column:
    return F.expr(f"size(filter({found}, w -> w IN ({', '.join(_quoted(words))})))")


def weight_sum(weights: Mapping[str, float], found: str = "_found") -> Column:
    total = F.lit(0.0)
    for options, weight in weights.items():
        total = total + F.when(has_any(options.split("|"), found), float(weight)).otherwise(0.0)
    return total


def best_of(counts: Mapping[str, Column]) -> Column:
    """Label with the highest positive count, the first declared on ties."""
    ranked = F.array(*[
        F.struct(count.cast("double").alias("n"), F.lit(-i).alias("i"), F.lit(label).alias("label"))
        for i, (label, count) in enumerate(counts.items())
    ])
    top = F.array_max(ranked)
    return F.when(top["n"] > 0, top["label"])


def _pick(system: Column, by_system: Mapping[str, Column]) -> Column:
    out = F
    for code, value in by_system.items():
        out = out.when(system == code, value)
    return out.otherwise(F.lit(None).cast("string"))


def with_words(entries: DataFrame, rules: Rules, name: str = "name", definition: str | None = "definition") -> DataFrame:
    """Adds ``_found`` and what the word lists say on their own."""
    found = with_found(entries, search_text(name, definition), rules.vocabulary())
    codes = [s for s in SYSTEMS if s in rules.systems]
    candidates = F.array_compact(F.array(*[
        F.when(has_any(rules.systems[s]),
               F.struct(F.lit(rules.priority[s]).alias("p"), (-how_many(rules.systems[s])).alias("m"),
                        F.lit(i).alias("i"), F.lit(s).alias("s")))
        for i, s in enumerate(codes)
    ]))
    polarity = F.coalesce(*[F.when(has_any(words), F.lit(p)) for p, words in rules.polarities.items()])
    objectives = {o: how_many(words) for o, words in tr.OBJECTIVE_WORDS.items()}
    about = F.coalesce(*[F.when(has_any(words), F.lit(k)) for k, words in tr.INFLAMMATION_WORDS.items()])
    best_sub = {s: best_of({c: how_many(w) for c, w in subs.items()}) for s, subs in rules.subsystems.items()}
    return found.withColumns(
        {
            "_candidates": candidates,
            "_polarity": polarity,
            "_about": about,
            "_general": F.lower(F.trim(name)).isin([n.lower() for n in tr.GENERAL_NAMES]),
            "_complex": has_any(tr.DESTRUCTIVE_WORDS) & has_any(tr.CONSTRUCTIVE_WORDS),
            "destructive_score": weight_sum(tr.DESTRUCTIVE_WEIGHTS),
            "constructive_score": weight_sum(tr.CONSTRUCTIVE_WEIGHTS),
            "_objective": best_of(objectives),
            "_objectives": F.array_compact(F.array(*[F.when(has_any(w), F.lit(o)) for o, w in tr.OBJECTIVE_WORDS.items()])),
            "_subs": F.struct(*[value.alias(f"s{code}") for code, value in best_sub.items()]),
        }
    )


def classify(entries: DataFrame, rules: Rules | None = None, name: str = "name",
             definition: str | None = "definition") -> DataFrame:
    """System, subsystem, all systems, polarity, confidence and decision path.

    General names come first, then texts with a destructive and a constructive
    side, then inflammation, then the plain rule: the only system found, or the
    one of highest priority.
    """
    rules = rules or Rules()
    rows = with_words(entries, rules, name, definition)

    top = F.array_min("_candidates")
    rows = rows.withColumns({
        "_systems": F.transform("_candidates", lambda c: c["s"]),
        "_top": top,
        "_rivals": F.size(F.filter("_candidates", lambda c: c["p"] == top["p"])),
    })
    nothing = F.size("_candidates") == 0
    single = F.size("_candidates") == 1
    standard = {
        "system": F.coalesce(F.col("_top.s"), F.lit("0")),
        "confidence": F.when(nothing, 0.1).when(single, 0.9).when(F.col("_rivals") == 1, 0.8).otherwise(0.7),
        "path": F.when(nothing, F.array(F.lit("no_pattern_match"), F.lit("default_to_system_0"))).otherwise(
            F.array(F.lit("pattern_matching"), F.concat(
                F.when(single, "single_match_").when(F.col("_rivals") == 1, "priority_rule_").otherwise("pattern_count_"),
                F.col("_top.s")))),
    }
    rows = rows.withColumn("_std", F.struct(*[v.alias(k) for k, v in standard.items()]))

    def verdict(system, confidence, *steps):
        return F.struct(
            system.alias("system") if isinstance(system, Column) else F.lit(system).alias("system"),
            F.lit(confidence).alias("confidence"),
            F.array(*[F.lit(s) if isinstance(s, str) else s for s in steps]).alias("path"),
        )

    wants = lambda *names: F.arrays_overlap("_objectives", F.array(*[F.lit(n) for n in names]))
    d, c = F.col("destructive_score"), F.col("constructive_score")
    goal = _pick(F.col("_objective"), {o: F.lit(s) for o, s in tr.OBJECTIVE_SYSTEMS.items()})
    undecided = F.struct(
        F.col("_std.system").alias("system"), F.col("_std.confidence").alias("confidence"),
        F.concat("_std.path", F.array(F.lit("balanced_pathway_standard_classification"))).alias("path"))
    mixed = (
        F.when(d > c * tr.DOMINANCE, F.when(
            wants("threat_elimination", "immune_defense"),
            verdict("B", 0.8, "complex_pathway", "destructive_dominant", "system_B"),
        ).otherwise(verdict("A", 0.6, "complex_pathway", "destructive_dominant", "system_A")))
        .when(c > d * tr.DOMINANCE, F.when(
            wants("tissue_repair", "structural_maintenance"),
            verdict("A", 0.8, "complex_pathway", "constructive_dominant", "system_A"),
        ).when(
            wants("metabolic_support"), verdict("C", 0.7, "complex_pathway", "constructive_dominant", "system_C"),
        ).otherwise(verdict("A", 0.6, "complex_pathway", "constructive_dominant", "system_A_default")))
        .when(F.col("_objective").isNull(), undecided)
        .otherwise(verdict(goal, 0.7, "complex_pathway", "balanced", "objective_based", F.concat(F.lit("system_"), goal)))
    )
    rows = rows.withColumn("_mixed", F.when(F.col("_complex"), mixed))

    kind = (
        F.when(F.col("_general"), "general").when(F.col("_complex"), "complex")
        .when(F.col("_polarity").isNotNull(), "inflammation").otherwise("standard")
    )
    rows = rows.withColumn("kind", kind)
    about = F.when(F.col("kind") == "inflammation", F.col("_about"))
    system = (
        F.when(F.col("kind") == "general", "0").when(F.col("kind") == "complex", F.col("_mixed.system"))
        .when(about.isin("threat", "tolerance"), "B").when(about.isin("resolution", "repair"), "A")
        .otherwise(F.col("_std.system"))
    )
    rows = rows.withColumn("system", system)
    own = _pick(F.col("system"), {s: F.col(f"_subs.s{s}") for s in rules.subsystems})
    moved = F.col("system") != F.col("_std.system")
    extra = (
        F.when((about == "threat") & moved, "inflammation_threat_clearance_rule")
        .when(about == "tolerance", "inflammation_tolerance_rule")
        .when(about == "resolution", "inflammation_resolution_rule")
        .when((about == "repair") & moved, "inflammation_repair_rule")
    )
    general, complex_ = F.col("kind") == "general", F.col("kind") == "complex"
    out = rows.withColumns({
        "subsystem": F.when(general, F.lit(None).cast("string")).when(about == "tolerance", "B3")
        .when(about == "resolution", "A4").otherwise(own),
        "all_systems": F.when(general, F.array(F.lit("0"))).otherwise(F.col("_systems")),
        "polarity": F.when(~general, F.col("_polarity")),
        "confidence": F.when(general, 0.9).when(complex_, F.col("_mixed.confidence") * tr.COMPLEX_DISCOUNT)
        .otherwise(F.col("_std.confidence")),
        "path": F.when(general, F.array(F.lit("excluded_general_term")))
        .when(complex_, F.concat("_mixed.path", F.array(F.lit("complex_pathway_analysis"))))
        .otherwise(F.concat("_std.path", F.array_compact(F.array(extra)))),
    })
    return out.select(*entries.columns, "kind", "system", "subsystem", "all_systems", "polarity", "confidence", "path",
                      "destructive_score", "constructive_score")


def detailed_subsystem(entries: DataFrame, system: str = "system", rules: Rules | None = None, name: str = "name",
                       definition: str | None = "definition") -> DataFrame:
    """Subsystem by word count times specificity, within the given system."""
    rules = rules or Rules()
    words = [w for subs in rules.subsystems.values() for ws in subs.values() for w in ws]
    rows = with_found(entries, search_text(name, definition), words)
    best = {
        s: best_of({c: how_many(w) * tr.SPECIFICITY.get(c, 1.0) for c, w in subs.items()})
        for s, subs in rules.subsystems.items()
    }
    return rows.withColumn("detailed_subsystem", _pick(F.col(system), best)).drop("_found")


def weighted_polarity(entries: DataFrame, rules: Rules | None = None, name: str = "name",
                      definition: str | None = "definition") -> DataFrame:
    """Polarity by word count times specificity."""
    rules = rules or Rules()
    words = [w for ws in rules.polarities.values() for w in ws]
    rows = with_found(entries, search_text(name, definition), words)
    # declared from the weakest, as the weakest comes first on ties
    order = list(reversed(list(rules.polarities)))
    score = {p: how_many(rules.polarities[p]) * tr.POLARITY_WEIGHTS.get(p, 1.0) for p in order}
    return rows.withColumn("weighted_polarity", best_of(score)).drop("_found")


def label_probabilities(entries: DataFrame, key: str, text: str,
                        graded: Mapping[str, Sequence[Sequence[str]]] | None = None,
                        least: float = tr.LEAST_PROBABILITY) -> DataFrame:
    """(key, label, probability): graded words add up per label, shares below
    ``least`` drop out and the rest is scaled to one."""
    graded = graded or tr.GRADED_WORDS
    words = [w for lists in graded.values() for ws in lists for w in ws]
    rows = with_found(entries.select(key, text), F.lower(text), words).select(key, "_found")
    labels = {label if label != "0" else "00": lists for label, lists in graded.items()}
    scores = {
        f"_{label}": sum((how_many(ws) * w for ws, w in zip(lists, tr.GRADE_WEIGHTS)), F.lit(0.0))
        * tr.SYSTEM_WEIGHTS[label[0]]
        for label, lists in labels.items()
    }
    rows = rows.withColumns(scores).withColumn("_total", sum((F.col(c) for c in scores), F.lit(0.0)))
    share = {c: F.when(F.col("_total") > 0, F.col(c) / F.col("_total")) for c in scores}
    rows = rows.select(key, *[F.when(p >= least, p).alias(c) for c, p in share.items()])
    rows = rows.withColumn("_kept", sum((F.coalesce(c, F.lit(0.0)) for c in scores), F.lit(0.0)))
    long = rows.unpivot([key, "_kept"], list(scores), "_label", "_p").filter(F.col("_p").isNotNull())
    return long.select(key, F.substring("_label", 2, 9).alias("label"), (F.col("_p") / F.col("_kept")).alias("probability"))


def label_statistics(probabilities: DataFrame, key: str, total: int) -> DataFrame:
    """Expected entries per system, and how many entries got several labels."""
    per_entry = probabilities.groupBy(key).agg(F.count(F.lit(1)).alias("_labels"))
    several = per_entry.agg(
        F.count(F.lit(1)).alias("classified"), F.count_if(F.col("_labels") > 1).alias("multi_label")
    ).first()
    weights = probabilities.groupBy(F.substring("label", 1, 1).alias("system")).agg(F.sum("probability").alias("weight"))
    return weights.withColumns({
        "classified": F.lit(several["classified"]), "multi_label": F.lit(several["multi_label"]), "total": F.lit(total)})


def first_match(text: Column, words: Mapping[str, Sequence[str]] | None = None) -> Column:
    """First label one of whose words occurs, ``U`` when none does."""
    words = words or tr.FIRST_MATCH_WORDS
    lower = F.lower(text)
    out = F
    for label, ws in words.items():
        out = out.when(any_hit(lower, ws), label)
    return out.otherwise("U")


def set_labels(entries: DataFrame, name: str, definition: str, ancestor_names: str,
               rules=None, ancestors=None) -> DataFrame:
    """All labels of an entry by its own words and its ancestors' names, and
    the one of highest priority."""
    rules, ancestors = rules or tr.SET_RULES, ancestors or tr.SET_ANCESTORS
    rows = entries.withColumn("_t", search_text(name, definition))
    text = F.col("_t")
    hits: dict[str, list[Column]] = {}
    for label, pattern, unless in rules:
        test = text.rlike(pattern)
        hits.setdefault(label, []).append(test & ~text.rlike(unless) if unless else test)
    for label, names in ancestors.items():
        hits.setdefault(label, []).append(
            F.exists(ancestor_names, lambda a: F.lower(a).rlike("(" + "|".join(names) + ")")))
    any_of = lambda tests: F.coalesce(F.greatest(*tests) if len(tests) > 1 else tests[0], F.lit(False))
    neural = any_of(hits.get("D neuro", [F.lit(False)]))
    hits.setdefault("C", []).append(text.rlike(tr.SET_TRANSPORT) & ~neural)
    labels = F.array_compact(F.array(*[F.when(any_of(hits[k]), F.lit(k)) for k in tr.SET_PRIORITY if k in hits]))
    rows = rows.withColumn("labels", labels)
    otherwise = F.when(text.rlike("(regulation|signaling)"), "General Regulation").otherwise("General Process")
    return rows.withColumn("primary", F.coalesce(F.try_element_at("labels", F.lit(1)), otherwise)).drop("_t")


def pattern_matches(entries: DataFrame, key: str, rules: Rules | None = None, name: str = "name", definition: str | None = "definition") -> DataFrame:
    """``(key, scope, code, pattern)``: every word of the rules that occurs in an entry, by system, subsystem and polarity."""
    rules = rules or Rules()
    lists = [("system", s, words) for s, words in rules.systems.items()]
    lists += [("subsystem", code, words) for subs in rules.subsystems.values() for code, words in subs.items()]
    lists += [("polarity", p, words) for p, words in rules.polarities.items()]
    found = with_found(entries.select(key, *dict.fromkeys(c for c in (name, definition) if c)), search_text(name, definition),
                       [w for *_, words in lists for w in words]).select(key, "_found")
    each = F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit(code).alias("code"), F.expr(f"filter(_found, w -> w IN ({', '.join(_quoted(words))}))").alias("patterns"))
        for scope, code, words in lists if words])
    return found.select(key, F.inline(each)).select(key, "scope", "code", F.explode("patterns").alias("pattern"))


def classification_text(name: Column, definition: Column, classes: Column, ancestors: Column, most: int = 5) -> Column:
    """Name, definition, class names and the first ``most`` ancestor names, those that there are, by blanks."""
    listed = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != ""))
    parts = F.concat(F.array(name, definition), listed(classes), F.slice(listed(ancestors), 1, most))
    return F.array_join(F.filter(parts, lambda w: w.isNotNull() & (w != "")), " ")


def entries_to_classify(terms: DataFrame, pathways: DataFrame) -> DataFrame:
    """Process terms that are not obsolete, and pathways, in one table of entries.

    ``terms (id, name, definition, namespace, is_obsolete)``, ``pathways (id, name, description)``.
    """
    kept = terms.filter((F.col("namespace") == "biological_process") & ~F.coalesce("is_obsolete", F.lit(False)))
    own = kept.select(F.col("id").cast("string").alias("id"), "name", "definition", F.lit("GO").alias("source"), "namespace")
    return own.unionByName(pathways.select(
        F.col("id").cast("string").alias("id"), "name", F.coalesce("description", F.lit("")).alias("definition"), F.lit("KEGG").alias("source"),
        F.lit("pathway").alias("namespace")))


def result_table(classified: DataFrame, stamp: str, version: str) -> DataFrame:
    """The fifteen columns of a delivered classification, with the subcategory's name and description."""
    details = F.create_map(*[x for code, (name, text) in tr.SUBCATEGORY_TEXTS.items() for x in (F.lit(code), F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")))])
    own = F.try_element_at(details, F.coalesce("subsystem", F.lit("")))
    return classified.select(
        F.col("id").alias("ID"), F.col("name").alias("Name"), F.col("definition").alias("Definition"), F.col("source").alias("Source"),
        F.col("namespace").alias("Namespace"), F.col("system").alias("Primary_System"), F.col("subsystem").alias("Subcategory_Code"),
        F.coalesce(own["name"], F.lit("")).alias("Subcategory_Name"), F.coalesce(own["text"], F.lit("")).alias("Subcategory_Description"),
        F.array_join("all_systems", ", ").alias("All_Systems"), F.coalesce("polarity", F.lit("")).alias("Inflammation_Polarity"),
        F.col("confidence").alias("Confidence_Score"), F.array_join("path", " > ").alias("Decision_Path"), F.lit(stamp).alias("Classification_Date"),
        F.lit(version).alias("Version"))
