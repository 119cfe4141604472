"""Closed-loop roll-outs of a stream of frames: each policy drives on as frames arrive, with its state in the state store.

A window's frames may come in any order, in any number of batches and repeatedly; a frame waits in the store until all before it have come. The state
of a window is one ego state for each policy, the last frame, and what waits: it is bounded by the window, and can be forgotten after `idle`. Rows equal
those that `rollouts.simulate` makes of the whole window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rollouts import PARAMETERS, POLICIES
from ..session import ship_package

FRAME = ("x", "y", "vx", "vy", "fx", "fy", "fvx", "fvy")
SCHEMA = "wid long, policy_id int, policy_name string, i long, x double, y double, vx double, vy double"


def _wrapped(angle: np.ndarray) -> np.ndarray:
    return (angle + np.pi) % (2 * np.pi) - np.pi


def advanced(s: dict[str, np.ndarray], f: dict[str, float], turn: float, p: dict[str, np.ndarray], dt: float) -> dict[str, np.ndarray]:
    """The ego states of all policies after one frame f, of which the source turns to the heading `turn` next."""
    speed, gap = np.hypot(s["vx"], s["vy"]), np.maximum(np.hypot(f["fx"] - s["x"], f["fy"] - s["y"]), 0.5)
    wanted = p["kp_thw"] * (gap / np.maximum(speed, 1e-3) - p["thw_target"]) - p["kd_vrel"] * (speed - np.hypot(f["fvx"], f["fvy"]))
    a = np.clip(s["a"] + np.clip(wanted - s["a"], -p["jerk_limit"], p["jerk_limit"]), p["a_min"], p["a_max"])
    smooth = p["heading_smooth_alpha"]
    aim = np.where(smooth > 0, s["aim"] + (1 - smooth) * _wrapped(turn - s["aim"]), turn)
    own = np.where(speed > 1e-3, np.arctan2(s["vy"], s["vx"]), np.arctan2(f["vy"], f["vx"]))
    heading = own + np.clip(_wrapped(aim - own), -p["yaw_rate_clip"], p["yaw_rate_clip"])
    speed = np.maximum(speed + a * dt, 0.0)
    vx, vy = speed * np.cos(heading), speed * np.sin(heading)
    return {"x": s["x"] + vx * dt, "y": s["y"] + vy * dt, "vx": vx, "vy": vy, "a": a, "aim": aim}


def _kept(value: dict[str, np.ndarray]) -> dict[str, list[float]]:
    return {c: v.tolist() for c, v in value.items()}


def drive(frames: DataFrame, names: tuple[str, ...] = tuple(POLICIES), dt: float = 0.1, idle: int | None = None) -> DataFrame:
    """wid, policy_id, policy_name, i, x, y, vx, vy of a stream of window frames (wid, i from 0, x, y, vx, vy, fx, fy, fvx, fvy) under each policy.
    idle: milliseconds without a frame after which a window's state is dropped; None keeps it. With it, the stream makes batches
    for the clock alone, so that a run over what is available now would not end."""
    if unknown := {*names} - {*POLICIES}:
        raise ValueError(f"unknown policies: {sorted(unknown)}")
    ship_package(frames.sparkSession)
    p = {c: np.array([POLICIES[n][k] for n in names]) for k, c in enumerate(PARAMETERS)}
    columns = ["wid", "policy_id", "policy_name", "i", "x", "y", "vx", "vy"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {"due": 0, "ego": None, "last": None, "waiting": {}}
        due, last, s = held["due"], held["last"], held["ego"] and {c: np.array(v) for c, v in held["ego"].items()}
        waiting = {int(i): f for i, f in held["waiting"].items()}
        for batch in batches:
            for i, *values in batch[["i", *FRAME]].itertuples(index=False):
                if i >= due:
                    waiting.setdefault(int(i), dict(zip(FRAME, map(float, values), strict=True)))
        out = []
        while due in waiting:
            f = waiting.pop(due)
            heading = float(np.arctan2(f["vy"], f["vx"]))
            same = lambda v: np.full(len(names), v)
            s = advanced(s, last, heading, p, dt) if s else {**{c: same(f[c]) for c in ("x", "y", "vx", "vy")}, "a": same(0.0), "aim": same(heading)}
            out += [(key[0], n, name, due, *(float(s[c][n]) for c in ("x", "y", "vx", "vy"))) for n, name in enumerate(names)]
            last, due = f, due + 1
        state.update((json.dumps({"due": due, "ego": s and _kept(s), "last": last, "waiting": waiting}),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=columns)

    return frames.groupBy("wid").applyInPandasWithState(run, SCHEMA, "held string", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)
