"""Tables and relation types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "id bigint, path string, phash string, phash_c1 int, phash_c2 int, phash_c3 int, phash_c4 int, file_size bigint, width int, height int, last_modified double"
SCANNED_PATHS = "path string"
CLUSTERS = "id bigint, name string, target_folder string, created_at timestamp"
CLUSTER_MEMBERS = "cluster_id bigint, file_path string"
FILE_RELATIONS = "id1 bigint, id2 bigint, relation_type string, distance double, created_at timestamp"
VECTOR_INDEX_STATUS = "path string, engine string, indexed_at timestamp"
VECTORS = "path string, engine string, embedding array<float>"

#: The closed set of relation types (fixed values).
RELATION_TYPES = ("new_match", "duplicate", "near_duplicate", "crop_duplicate", "similar", "similar_style", "same_person", "same_image_set", "other", "not_duplicate")
NEW_MATCH, NOT_DUPLICATE = "new_match", "not_duplicate"

#: Default thresholds by engine (fixed values): Hamming bits, cosine distance.
THRESHOLDS = {"phash": 5, "clip": 0.1, "blip": 0.1, "mobilenet": 0.1}
BATCH_SIZES = {"phash": 32, "clip": 8, "blip": 8, "mobilenet": 16}
EMBEDDING_WIDTHS = {"mobilenet": 576, "clip": 512, "blip": 768}


def relation_type(t: Column) -> Column:
    """Unknown types read as a new match."""
    return F.when(t.isin(*RELATION_TYPES), t).otherwise(F.lit(NEW_MATCH))
