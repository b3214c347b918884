"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from capturelake.llm.audio import op7_audio
from capturelake.llm.fim import FIM_SQL, op11_fill_in_middle
from capturelake.llm.jaccard_join import JACCARD_SQL, op13_jaccard_join
from capturelake.llm.mixing import MIX_SQL, op8_mixing
from capturelake.llm.near_dup import op1_near_dup
from capturelake.llm.packing import op6_packing
from capturelake.llm.periodic import op12_periodic_runs
from capturelake.llm.quality import op2_quality
from capturelake.llm.repeats import op3_repeats
from capturelake.llm.secrets import op10_secrets
from capturelake.llm.sharding import SHARD_SQL, op4_sharding
from capturelake.llm.token_files import op9_token_files
from capturelake.llm.warc import op5_warc

QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_quality": op2_quality,
    "op3_repeats": op3_repeats,
    "op4_sharding": op4_sharding,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_audio": op7_audio,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_secrets": op10_secrets,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_jaccard_join": op13_jaccard_join,
}
SQL = {
    "op4_sharding": SHARD_SQL,
    "op8_mixing": MIX_SQL,
    "op11_fill_in_middle": FIM_SQL,
    "op13_jaccard_join": JACCARD_SQL,
}
