"""From documents to sampled token ids: language, near duplicates, secrets, source mix, sampled pieces."""

from docloom.llm.pipeline import STAGES as STAGES
from docloom.llm.pipeline import run as run

#: Near-duplicate search, language profiles and sampled segmentations can't be expressed in SQL.
ORACLE_SQL = None
