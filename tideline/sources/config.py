"""Configuration sources: protocol specifications, front matter, the chain's head; one text on the driver, or a column of them."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS = re.compile(r"0x[0-9a-fA-F]{40}")


@dataclass(frozen=True)
class Protocol:
    name: str
    chain_id: int
    fee_tier: int  # millionths
    pool: str
    finality: int = 120
    vaults: Mapping[str, Mapping] = field(default_factory=dict)
    rest: Mapping = field(default_factory=dict)

    def active_vaults(self) -> list[str]:
        return [k for k, v in self.vaults.items() if v.get("active")]


def load_protocol(text: str) -> Protocol:
    """A specification from TOML text: addresses are checked, finality defaults to 120 blocks."""
    p = tomllib.loads(text)["protocol"]
    pool = p.get("anchor_pool", {})
    address = pool.get("address", pool.get("pool_address", ""))
    for a in [address, *(v.get("address", address) for v in p.get("vaults", {}).values())]:
        if not ADDRESS.fullmatch(a):
            raise ValueError(f"no address: {a!r}")
    known = {"name", "chain_id", "finality", "anchor_pool", "vaults"}
    return Protocol(p.get("name", ""), int(p.get("chain_id", 0)), int(pool.get("fee_tier_bps", pool.get("fee_tier", 0))), address.lower(), int(p.get("finality", 120)), p.get("vaults", {}), {k: v for k, v in p.items() if k not in known})


def front_matter(text: str) -> dict[str, str]:
    """The simple key: value lines between the first two --- of a document; empty where there are none."""
    m = re.match(r"---\n(.*?)\n---", text, re.S)
    pairs = (line.split(":", 1) for line in (m[1].split("\n") if m else []) if re.match(r"[A-Za-z_][\w-]*\s*:", line))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def calibration(text: str, evidence: str) -> dict[str, str]:
    """Front matter of a calibration; its evidence source must be the one expected."""
    got = front_matter(text)
    if got.get("evidence_source") != evidence:
        raise ValueError(f"evidence_source is {got.get('evidence_source')!r}, not {evidence!r}")
    return got


def verdict(text: str) -> str | None:
    v = front_matter(text).get("verdict")
    return v.upper() if v else None


def resolve_head(env: str | None, snapshot: int | None, constant: int | None, live: Callable[[], int] | None, dry_run: bool = False) -> int:
    """The head block: environment, then snapshot, then constant, then live, which a dry run never asks."""
    for x in (env, snapshot, constant):
        if x not in (None, ""):
            return int(x)
    if dry_run or live is None:
        raise ValueError("no head block is known")
    return int(live())


SPEC_FIELDS = "name string, chain_id int, fee_tier int, pool string, finality int, vault string, active boolean, error string"


def protocols(specs: DataFrame, text: str, key: str) -> DataFrame:
    """key and SPEC_FIELDS: a row a vault of each specification in the column `text`, one row with a null vault where it
    names none. A text that is null, no TOML or holds a bad address is one row with its error alone."""
    names = [f.split()[0] for f in SPEC_FIELDS.split(", ")]

    def rows(text: str | None) -> list[dict]:
        try:
            p = load_protocol(text or "")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return [{"error": f"{type(e).__name__}: {e}"}]
        own = {"name": p.name, "chain_id": p.chain_id, "fee_tier": p.fee_tier, "pool": p.pool, "finality": p.finality}
        return [own | {"vault": k, "active": bool(v.get("active"))} for k, v in p.vaults.items()] or [own]

    def run(batches):
        for pdf in batches:
            out = [{key: k} | r for k, t in zip(pdf[key], pdf[text], strict=True) for r in rows(t)]
            kinds = {"chain_id": "Int32", "fee_tier": "Int32", "finality": "Int32", "active": "boolean"}
            yield pd.DataFrame(out, columns=[key, *names]).astype({n: kinds.get(n, object) for n in names})

    return specs.select(key, text).mapInPandas(run, f"{key} {specs.schema[key].dataType.simpleString()}, {SPEC_FIELDS}")


def front_matter_value(text: Column, key: str) -> Column:
    """The value of a key in a text's front matter, the last one where it repeats; null without front matter or key."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.trim(F.substring_index(x, ":", 1)) == key)
    value = F.trim(F.regexp_replace(F.get(lines, F.size(lines) - 1), "^[^:]*:", ""))
    return F.when(F.size(lines) > 0, F.regexp_replace(value, "^[\"']+|[\"']+$", ""))


def head_of(env: Column, snapshot: Column, constant: Column) -> Column:
    """resolve_head() for columns, without a live source: an empty environment is none."""
    return F.coalesce(F.nullif(env, F.lit("")).cast("long"), snapshot.cast("long"), constant.cast("long"))
