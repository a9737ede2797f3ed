"""Table and record types."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_NAMED = T.StructType(_strings("display_name"))

# Source A: one offer of a result page. Every field may be missing.
RAW_A = T.StructType(
    [
        *_strings("id", "title", "description"),
        T.StructField("company", _NAMED),
        T.StructField("location", _NAMED),
        *_strings("contract_time", "contract_type"),
        T.StructField("salary_min", T.DoubleType()),
        T.StructField("salary_max", T.DoubleType()),
        *_strings("created", "redirect_url"),
    ]
)

# Source A: one landed result page; its offers are read field by field.
PAGE_A = T.StructType(
    [
        T.StructField("target_no", T.LongType()),
        T.StructField("request_no", T.LongType()),
        *_strings("pays", "localisation", "mot_cle"),
        T.StructField("page", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("results", T.ArrayType(T.VariantType())),
    ]
)

# Source C: one landed row.
RAW_C = T.StructType(
    _strings("job_url", "url", "title", "company", "location", "description", "job_description", "date_posted")
)

# Sources B and C as landed: where the record arrived, and the record.
ITEM_B = T.StructType(
    [
        T.StructField("request_no", T.LongType()),
        T.StructField("position", T.LongType()),
        *_strings("item"),
    ]
)
ROW_C = T.StructType(
    [
        T.StructField("request_no", T.LongType()),
        T.StructField("position", T.LongType()),
        *RAW_C.fields,
        T.StructField("posted_at", T.TimestampType()),
    ]
)

# Sources B and C after reading.
EXTERNAL = T.StructType(
    _strings(
        "titre", "entreprise", "localisation", "description", "url", "source",
        "date_publication", "salaire", "type_contrat",
    )
)

# Stored offer, without the columns that later changes set.
OFFER_TEXTS = [
    "id", "intitule", "description", "entreprise_nom", "lieu_travail", "type_contrat",
    "salaire_libelle", "date_creation", "url", "raw_json",
]
OFFER = T.StructType(
    [
        *_strings(*OFFER_TEXTS),
        T.StructField("collected_at", T.TimestampType()),
        T.StructField("version", T.LongType()),
    ]
)

# Changes to stored offers; each is an append.
SCORE = T.StructType(
    [
        *_strings("id"),
        T.StructField("score", T.IntegerType()),
        *_strings("score_explication", "score_points_forts", "score_points_faibles"),
        T.StructField("score_date", T.TimestampType()),
        T.StructField("version", T.LongType()),
    ]
)
STATUS_CHANGE = T.StructType([*_strings("id", "statut"), T.StructField("version", T.LongType())])
TOMBSTONE = T.StructType([*_strings("id"), T.StructField("version", T.LongType())])
RUN = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("run_at", T.TimestampType()),
        T.StructField("new_offers", T.LongType()),
        T.StructField("scored_offers", T.LongType()),
        *_strings("report_path", "export_path"),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("candidat", T.StructType(_strings("poste_cible"))),
        T.StructField(
            "competences",
            T.StructType(
                [
                    T.StructField("techniques", T.ArrayType(T.StringType())),
                    T.StructField("soft_skills", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("experience", T.StructType(_strings("annees_totales"))),
        T.StructField(
            "criteres",
            T.StructType(
                [
                    T.StructField("types_contrat", T.ArrayType(T.StringType())),
                    *_strings("salaire_min_annuel", "teletravail_souhaite"),
                    T.StructField("localisations_acceptees", T.ArrayType(T.StringType())),
                    T.StructField("secteurs_preferes", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "preferences_entreprise",
            T.StructType(
                [
                    *_strings("taille_preferee"),
                    T.StructField("culture", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)
