"""Prompts with an exact contract of placeholders, and their digests."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = re.compile(r"\{\{(\w+)\}\}")


@dataclass(frozen=True)
class Prompt:
    name: str
    version: str
    template: str

    @property
    def places(self) -> list[str]:
        return list(dict.fromkeys(_PLACE.findall(self.template)))

    @property
    def digest(self) -> str:
        return hashlib.sha256(f"{self.name}:{self.version}:{self.template}".encode()).hexdigest()

    def render(self, **values: Column) -> Column:
        """The prompt as a column; every placeholder needs a value and every value a placeholder. Values aren't read as templates."""
        if set(values) != set(self.places):
            raise ValueError(f"{self.name} takes {', '.join(self.places)}")
        parts = re.split(_PLACE, self.template)
        return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


EXTRACT = Prompt("extract", "1", "List the survey variables of the following part of a questionnaire as data.\nPart: {{chunk_id}}\nRows that repeat in the document: {{inventory}}\n---\n{{text}}")
METADATA = Prompt("metadata", "2", "Name the survey, country and year of this document as data: survey_id, country_code, year, survey_name, and where told study_type, data_collection_mode, language.\nPart: {{chunk_id}}\n---\n{{text}}")
