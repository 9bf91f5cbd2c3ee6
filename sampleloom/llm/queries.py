"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from .alignment import op12_alignment
from .credential_scan import op3_secret_scan
from .langid import op2_language_id
from .length_buckets import op9_length_buckets
from .license_digest import OP8_SQL, op8_license_digest
from .multiprobe import op4_multiprobe
from .ogg import op1_ogg
from .pareto_mix import OP7_SQL, op7_pareto_mix
from .prefix_counts import op13_prefix_counts
from .repair import op6_repair
from .rule_ensemble import op10_rule_ensemble
from .setsketch import op5_near_duplicates
from .simplex_kmeans import OP11_SQL, op11_simplex_kmeans

QUERIES = {
    "op1_ogg": op1_ogg,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_multiprobe": op4_multiprobe,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_repair": op6_repair,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_license_digest": op8_license_digest,
    "op9_length_buckets": op9_length_buckets,
    "op10_rule_ensemble": op10_rule_ensemble,
    "op11_simplex_kmeans": op11_simplex_kmeans,
    "op12_alignment": op12_alignment,
    "op13_prefix_counts": op13_prefix_counts,
}
ORACLES: dict[str, str] = {"op7_pareto_mix": OP7_SQL, "op8_license_digest": OP8_SQL, "op11_simplex_kmeans": OP11_SQL}
