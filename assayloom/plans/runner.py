"""Plans: named stages with inputs and outputs, run in order with a record of what each read and wrote."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import content_hash, read_text_table, write_table


@dataclass
class Stage:
    id: str
    command: str
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    arguments: dict = field(default_factory=dict)


@dataclass
class Plan:
    name: str
    plan_commit: str
    stages: list[Stage]

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([vars(s) for s in self.stages], sort_keys=True).encode()).hexdigest()


def parse(text: str) -> Plan:
    """A plan from JSON or YAML; ${name} stands for vars, an unknown one is an error."""
    try:
        told = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ModuleNotFoundError:
            raise ValueError("the plan is no JSON, and there is nothing here that reads YAML") from None
        told = yaml.safe_load(text)
    missing = [k for k in ("name", "plan_commit", "stages") if not isinstance(told, dict) or not told.get(k)]
    if missing:
        raise ValueError(f"the plan lacks {', '.join(missing)}")
    names = told.get("vars", {})

    def filled(x):
        if isinstance(x, str):

            def value(m: re.Match) -> str:
                if m[1] not in names:
                    raise ValueError(f"unknown variable {m[1]}")
                return str(names[m[1]])

            return re.sub(r"\$\{(\w+)\}", value, x)
        if isinstance(x, dict):
            return {k: filled(v) for k, v in x.items()}
        return [filled(v) for v in x] if isinstance(x, list) else x

    stages = [Stage(**filled(s)) for s in told["stages"]]
    if len({s.id for s in stages}) < len(stages):
        raise ValueError("two stages have one id")
    return Plan(told["name"], told["plan_commit"], stages)


def dry_run(plan: Plan, available: set[str]) -> list[str]:
    """Inputs that neither are there nor come from an earlier stage."""
    known, problems = set(available), []
    for s in plan.stages:
        problems += [f"{s.id}: {i} is missing" for i in s.inputs if i not in known]
        known.update(s.outputs)
    return problems


def external(script: str, spark: SparkSession, inputs: dict[str, DataFrame], outputs: list[str], folder: str, timeout: float = 3600) -> dict[str, DataFrame]:
    """A stage by a tool of one's own: `script <input folder> <output folder>` on the driver's host.

    Inputs are written as tab-separated folders below `folder`, which that host must see; each output is read back
    from the output folder. An exit status other than zero, or an output that isn't there, is an error.
    """
    for name, df in inputs.items():
        write_table(df, f"{folder}/in/{name}")
    done = subprocess.run([script, f"{folder}/in", f"{folder}/out"], capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"{script} ended with {done.returncode}: {done.stderr.strip()[-500:]}")
    found = {}
    for name in outputs:
        if not os.path.exists(f"{folder}/out/{name}"):
            raise RuntimeError(f"{script} made no {name}")
        found[name] = read_text_table(spark, f"{folder}/out/{name}", "\t")
    return found


def run(spark: SparkSession, plan: Plan, commands: dict[str, Callable[..., dict[str, DataFrame]]], tables: dict[str, DataFrame], last: dict | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Run the stages; a command takes (spark, inputs, **arguments) and returns its outputs by name.

    last: the record of an earlier run. With the same plan_commit but other stages, the plan has drifted and is refused.
    """
    if last and last["plan_commit"] == plan.plan_commit and last["digest"] != plan.digest():
        raise ValueError("the plan changed under the same plan_commit")
    problems = dry_run(plan, set(tables))
    if problems:
        raise ValueError("; ".join(problems))
    held, record = dict(tables), {"name": plan.name, "plan_commit": plan.plan_commit, "digest": plan.digest(), "stages": []}
    for s in plan.stages:
        made = commands[s.command](spark, {i: held[i] for i in s.inputs}, **s.arguments)
        if set(made) != set(s.outputs):
            raise ValueError(f"{s.id} made {sorted(made)}, not {sorted(s.outputs)}")
        held.update(made)
        record["stages"].append({"id": s.id, "inputs": {i: content_hash(held[i]) for i in s.inputs}, "outputs": {o: content_hash(held[o]) for o in s.outputs}})
    return held, record
