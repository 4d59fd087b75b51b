"""Constants of the people table and the settings of an analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Features, their source columns and separators, weights.
FEATURES = ("role", "experience", "industry", "market", "offering", "persona")
COLUMNS = {
    "role": "Professional Identity - Role Specification",
    "experience": "Professional Identity - Experience Level",
    "industry": "Company Identity - Industry Classification",
    "market": "Company Market - Market Traction",
    "offering": "Company Offering - Value Proposition",
    "persona": "All Persona Titles",
}
IDENTITY = ("Person Name", "Person Title", "Person Company")
ESSENTIAL = (*IDENTITY, *COLUMNS.values())
OPTIONAL = ("LinkedIn URL",)
SEPARATORS = {f: ";" if f == "persona" else "|" for f in FEATURES}
GROUPS = {"business": ("industry", "market", "offering"), "personal": ("role", "experience", "persona")}
SIMILARITY_WEIGHTS = dict.fromkeys(FEATURES, 1.0)
COMPLEMENTARITY_WEIGHTS = {"role": 1.2, "experience": 1.5, "industry": 1.1, "market": 1.1, "offering": 1.2, "persona": 0.9}
#: Words that a CSV reader takes for a missing value.
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

PEOPLE = T.StructType([T.StructField(c, T.StringType()) for c in (*ESSENTIAL, *OPTIONAL)])
FILES = "file_id string, user_id string, filename string, original_filename string, created_at timestamp, updated_at timestamp, current_version_id string, file_type string, metadata map<string,string>, tags array<string>"
FILE_VERSIONS = "version_id string, file_id string, version_number int, created_at timestamp, description string, data_hash string, row_count long, column_count int, file_size long, file_path string"
JOB_EVENTS = "job_id string, user_id string, file_id string, job_type string, status string, progress double, at timestamp, result_data string, error_message string"
ACTIVE, FINISHED = ("pending", "queued", "running"), ("completed", "failed", "cancelled")


@dataclass(frozen=True)
class Settings:
    """What the reference behaviour takes from its environment, as plain values."""

    min_density: float = 0.1
    dimensions: int = 384
    default_score: float = 0.5
    rho: float = 0.5
    lam: float = 0.5
    eta: float = 0.2
    gamma: float = 0.85
    p_similarity: float = 0.0
    p_complementarity: float = 0.5
    dense_above: float = 0.3
    exact_cycle: int = 10
    seed: int = 42
    batch_peeling: float = 0.0
    #: Largest graph that one task takes as a dense matrix; larger ones go to batch peeling and label propagation.
    dense_nodes: int = 10_000
