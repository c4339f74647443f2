"""The ten seed rules as data. Names, keys, thresholds and condition trees in seed_rules.json are given."""

import json
from pathlib import Path


def seed_rules() -> dict[str, dict]:
    return {s["slug"]: s for s in json.loads((Path(__file__).parent / "seed_rules.json").read_text())}
