"""Problem 10: subject areas of documents.

Subject terms are curated seeds plus terms fitted on a bounded sample of the hand-labelled documents: a word is a term
of a subject if it stands in enough labelled documents of enough companies and nearly all of them have that label. A
term weighs more the surer and the rarer it is. A multi-pattern automaton finds the terms of a whole text; a sentence
belongs to the subject with the largest weight in it, and a document to every subject whose part of its own sentences
reaches the subject's threshold. Repeated notices and lines of figures hold no subject terms, so sentences without any
are not counted as the document's own; a subject must also reach FLOOR of all sentences, so a stray term alone never
decides. Thresholds are calibrated: with terms fitted on one half of the labelled sample, those of SHARES are measured on
the other half, and of the thresholds whose F1 comes within a standard error of the best, or NEAR, the one nearest to
SHARE is taken, a third by the statement of the problem. A subject with fewer than LEAST_HELD labels there keeps SHARE.

Defined results: null, empty and termless texts have no subject; labels that name no document, repeated labels and
null labels are ignored; rows of one doc_id count once; of equal weights in a sentence the first subject by name wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import durable, once_per_key, table

SHARE, FLOOR = 1 / 3, 0.1
#: What calibration tries, how much F1 may always fall short of the best, and how many held-out labels it needs.
SHARES, NEAR, LEAST_HELD = (0.2, 0.25, 0.3, 1 / 3, 0.36, 0.4, 0.45, 0.5), 0.01, 20
#: The fit reads at most so many labelled documents and keeps at most so many terms of a subject.
SAMPLE_DOCS, MAX_TERMS = 20_000, 400
MIN_DOCS, MIN_COMPANIES, SURE = 3, 2, 0.55

#: Curated terms in English, German, French and Spanish.
SEEDS = {
    "retail": "store shopper aisle checkout basket filiale sortiment warenkorb rabatt kundin magasin rayon caisse panier clientèle tienda cajero descuento escaparate surtido",
    "semiconductors": "wafer chip transistor foundry silicon halbleiter schaltkreis reinraum silizium leiterplatte puce plaquette fonderie semi-conducteur capteur oblea semiconductor circuito silicio microchip",
    "farming": "tractor harvest crop irrigation livestock traktor ernte getreide acker saatgut tracteur récolte semoir élevage verger cosechadora siembra riego ganado huerto",
    "recruitment": "vacancy candidate headcount hiring recruiter bewerber lebenslauf stellenanzeige zeitarbeit probezeit recruteur embauche préavis candidat intérim candidato vacante entrevista nómina contratación",
    "health": "patient clinic nurse surgeon vaccine patientin klinik impfung arzt krankenhaus infirmière vaccin chirurgien médecin hôpital paciente enfermera vacuna cirujano hospital",
    "energy": "turbine megawatt refinery pipeline electrolyser kraftwerk stromnetz windrad raffinerie wärmepumpe éolienne raffinerie-pétrole centrale gazoduc réseau-électrique refinería megavatio gasoducto turbina aerogenerador",
    "law": "plaintiff tribunal verdict lawsuit injunction klägerin urteil gericht berufung klageschrift plaignant avocat témoin plaidoirie litige abogado juzgado sentencia demandante testigo",
    "sport": "midfielder goalkeeper championship stadium referee torwart mannschaft meisterschaft elfmeter spielzeit entraîneur tournoi stade gardien maillot portero árbitro torneo entrenadora camiseta",
    "software": "codebase compiler repository backend microservice quelltext datenbank schnittstelle compilateur rechenzentrum logiciel serveur programmeur dépôt nuage programa servidor repositorio contraseña compilador",
    "logistics": "freight warehouse forklift haulage pallet spedition lagerhalle gabelstapler fracht umschlag entrepôt camion fret remorque conteneur almacén flete contenedor camión carretilla",
}

_WORDS = r"\p{L}+(?:-\p{L}+)*"
_END = re.compile(r"[.!?](?=\s|$)|\n")


def labelled(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, subjects, company, text, words) of at most `limit` labelled documents, chosen by a hash of the id."""
    by_doc = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    sample = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    own = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"\P{L}+")
    rows = documents.where("text is not null").select("doc_id", "company", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "company", "subjects")).alias("r")).select("doc_id", "r.text", "r.company", "r.subjects")
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), 0)), own(F.col("company")))
    return rows.select("doc_id", "subjects", F.lower(F.trim("company")).alias("company"), "text", words.alias("words"))


def fit(sample: DataFrame, subjects: list[str], max_terms: int = MAX_TERMS) -> dict[str, dict[str, float]]:
    """Terms and weights per subject from labelled(); at most max_terms of each reach the driver."""
    if not subjects:
        return {}
    counts = [F.count_if(F.array_contains("subjects", s)) for s in subjects]
    rows = sample.select("subjects", "company", F.explode("words").alias("word"))
    per_word = rows.groupBy("word").agg(F.count("*").alias("n"), F.approx_count_distinct("company").alias("companies"), F.array(*counts).alias("k"))
    best = per_word.where((F.col("n") >= MIN_DOCS) & (F.col("companies") >= MIN_COMPANIES) & (F.length("word") >= 3)).select("word", "n", "k", F.array_max("k").alias("top"))
    best = best.where((F.col("top") - 0.7) / (F.col("n") + 0.3) >= SURE).select("word", "n", "top", F.array_position("k", F.col("top")).cast("int").alias("subject"))
    out: dict[str, dict[str, float]] = {s: {} for s in subjects}
    n_docs = max(1, sample.count())
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("top"), "word"))).where(F.col("r") <= max_terms)
    for r in ranked.collect():
        rare = 1 + math.log(n_docs / r["n"]) / math.log(n_docs + 1)
        out[subjects[r["subject"] - 1]][r["word"]] = r["top"] / r["n"] * rare
    for s in subjects:
        for w in SEEDS.get(s, "").split():
            if not any(w in t for t in out.values()):
                out[s][w] = 1.0
    return out


def scorer(terms: dict[str, dict[str, float]]):
    """mapInArrow function: (doc_id, subject, sentences, own, all) for every subject found in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        names = sorted(terms)
        a = ahocorasick.Automaton()
        for i, s in enumerate(names):
            for w, weight in terms[s].items():
                a.add_word(w, (len(w), i, weight))
        if len(a):
            a.make_automaton()
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = text.lower()
                n = len(t)
                ends = [m.start() for m in _END.finditer(t)]
                ends.append(n)
                votes: dict[int, int] = {}
                at, own, here = 0, 0, {}
                for last, (size, i, weight) in a.iter(t) if len(a) else ():
                    first = last - size
                    if first >= 0 and ((c := t[first]).isalpha() or c == "-"):
                        continue
                    if last + 1 < n and ((c := t[last + 1]).isalpha() or (c == "-" and last + 2 < n and t[last + 2].isalpha())):
                        continue
                    while ends[at] < last:
                        if here:
                            best = max(here, key=lambda k: (here[k], -k))
                            votes[best] = votes.get(best, 0) + 1
                            own += 1
                            here = {}
                        at += 1
                    here[i] = here.get(i, 0.0) + weight
                if here:
                    best = max(here, key=lambda k: (here[k], -k))
                    votes[best] = votes.get(best, 0) + 1
                    own += 1
                if votes:
                    sentences = sum(1 for x, y in zip([-1, *ends], ends, strict=False) if y - x > 2)
                    out.extend((doc_id, names[i], v, own, sentences) for i, v in votes.items())
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "subject", "sentences", "own", "n_all"])

    return run


_VOTES = "doc_id long, subject string, sentences int, own int, n_all int"


def measured(sample: DataFrame, subjects: list[str]) -> DataFrame:
    """(subject, share, right, wrong, labels): for each threshold the held-out half's assignments with and without the label, and its labels.

    One row per subject and threshold, from terms fitted on the other half.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(2)) == 0
    terms = fit(sample.where(half), subjects)
    held = sample.where(~half)
    v = held.select("doc_id", "text").mapInArrow(scorer(terms), _VOTES).where(F.col("sentences") >= F.col("n_all") * F.lit(FLOOR))
    true = held.select("doc_id", F.explode("subjects").alias("subject"), F.lit(1).alias("label"))
    both = v.select("doc_id", "subject", (F.col("sentences") / F.col("own")).alias("part")).join(true, ["doc_id", "subject"], "full")
    each = both.select("subject", F.coalesce("part", F.lit(0.0)).alias("part"), F.coalesce("label", F.lit(0)).alias("label"), F.explode(F.array(*[F.lit(s) for s in SHARES])).alias("share"))
    over = F.col("part") >= F.col("share") - 1e-9
    return each.groupBy("subject", "share").agg(F.count_if(over & (F.col("label") == 1)).alias("right"), F.count_if(over & (F.col("label") == 0)).alias("wrong"), F.sum("label").alias("labels"))


def calibrated(sample: DataFrame, subjects: list[str]) -> dict[str, tuple[float, float, float, int]]:
    """subject: (threshold, precision and recall of it on held-out labels, how many these are)."""
    out = dict.fromkeys(subjects, (SHARE, 0.0, 0.0, 0))
    tried: dict[str, list[tuple]] = {}
    for r in measured(sample, subjects).collect() if subjects else ():  # as many rows as subjects times SHARES
        tried.setdefault(r["subject"], []).append((2 * r["right"] / max(1, r["right"] + r["wrong"] + r["labels"]), r["share"], r["right"] / max(1, r["right"] + r["wrong"]), r["right"] / max(1, r["labels"]), r["labels"]))
    for s, rows in tried.items():
        if s not in out:
            continue
        best, n = max(rows)[0], rows[0][4]
        near = max(NEAR, math.sqrt(best * (1 - best) / max(1, n)))
        usable = [r for r in rows if r[0] >= best - near] if n >= LEAST_HELD else [r for r in rows if r[1] == SHARE]
        _, share, precision, recall, n = min(usable, key=lambda r: (abs(r[1] - SHARE), r[1]))
        out[s] = (share, precision, recall, n)
    return out


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    # subjects is a table of fixed size
    names = sorted({r[0] for r in table(spark, sf_dir, "subjects").select("subject").collect() if r[0]})
    return durable(labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels")), "labelled"), names


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, subject, sentences, own, n_all, enough): how many sentences of each document belong to each subject, and whether that assigns it."""
    sample, names = _labels(spark, sf_dir)
    shares = {s: c[0] for s, c in calibrated(sample, names).items()}
    texts = once_per_key(table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", "text"), "doc_id")
    v = texts.mapInArrow(scorer(fit(sample, names)), _VOTES)
    return v.withColumn("enough", enough(shares))


def enough(shares: dict[str, float], floor: float = FLOOR) -> Column:
    """Whether a subject's sentences reach its threshold; subjects are few and fixed."""
    share = F.coalesce(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("subject")], F.lit(SHARE)) if shares else F.lit(SHARE)
    return (F.col("sentences") >= F.col("own") * share - F.lit(1e-9)) & (F.col("sentences") >= F.col("n_all") * F.lit(floor))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir).where("enough").select("doc_id", "subject")


def p10_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's threshold, with precision and recall on held-out labels and how many these are."""
    rows = [(s, *c) for s, c in sorted(calibrated(*_labels(spark, sf_dir)).items())]
    return spark.createDataFrame(rows, "subject string, share double, precision double, recall double, labels int")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents assigned, and share of all sentences that belong to a subject."""
    per = votes(spark, sf_dir).groupBy("subject").agg(F.sum("sentences").alias("sentences"), F.count_if("enough").alias("documents"))
    whole = F.sum("sentences").over(Window.partitionBy(F.lit(1)))
    return per.select("subject", "documents", "sentences", F.round(F.col("sentences") / whole, 6).alias("share"))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition, "p10_thresholds": p10_thresholds}
ORACLES: dict[str, str] = {}
