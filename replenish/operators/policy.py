"""Order-up policies on a stock grid, one per item, by policy iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replenish.operators.joins import spread_by_item
from replenish.params import Params

# items whose equations are solved at once, and the gain below which two orders count as equal
BLOCK = 64
SAME = 1e-7


def demand_histogram(daily: DataFrame, key: str = "medicine_id") -> DataFrame:
    """Distinct daily demands and their counts per item, as two arrays bounded by the number of days."""
    counts = daily.groupBy(key, "demand").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("demand", "n")))
    return counts.groupBy(key).agg(pairs["demand"].alias("demands"), pairs["n"].alias("counts"))


def nearest_level(stock: Column, step: int = 10, top: int = 1000) -> Column:
    """Index of the nearest grid level, ties to the lower one."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(float(top)), stock))
    return F.greatest(F.lit(0), F.ceil(inside / step - 0.5).cast("int"))


def optimal_policy(histograms: DataFrame, params: Params = Params()) -> DataFrame:
    """Best order size and value per item and stock level, with the rounds it took and whether they converged.

    A round solves the linear equations of the current policy's values exactly and then improves the policy at
    every level; it ends when no order changes, after a few rounds as a rule and ``policy_rounds`` at most. What
    follows an order depends on stock + order only, so one product per round gives the value of every reachable
    level, and the best order is a sliding maximum over those. A level leads down by as much as its item's demands
    reach, so products go over falls, not over all states. Many items are solved at once. Of orders of equal value the
    smallest is taken.
    """
    step, top, most = params.policy_step, params.policy_max_stock, params.policy_max_order
    states, actions = np.arange(0, top + 1, step), np.arange(0, most + 1, step)
    levels = np.arange(0, top + most + 1, step)
    gamma, holding = params.policy_discount, params.holding_cost
    fixed, shortage = params.order_cost, params.shortage_cost
    here, last = np.arange(len(states)), len(states) - 1

    def transitions(demands: list, counts: list) -> tuple[np.ndarray, tuple]:
        """Cost of every level, and where it leads: shares of the falls by one, two.. levels, to the bottom and to the top."""
        size, widest = len(demands), max(map(len, demands))
        demand, share = np.zeros((2, size, widest))
        for i, (d, n) in enumerate(zip(demands, counts)):
            demand[i, : len(d)], share[i, : len(d)] = d, np.asarray(n, float) / np.sum(n)
        left = levels[:, None, None] - demand
        inside = np.clip(left, 0, top)
        inside /= step
        inside -= 0.5
        following = np.ceil(inside, out=inside).astype(np.int32)
        np.maximum(following, 0, out=following)
        level = np.arange(len(levels), dtype=np.int32)[:, None, None]
        fall = level - following
        low, high = following == 0, (following == last) & (level > last)
        # returns lead upwards
        up = max(0, -int(fall[~high].min(initial=0)))
        width = up + 1 + max(0, int(fall[~low & ~high].max(initial=0)))
        place = fall + up
        place[low], place[high] = width, width + 1
        place += level * (width + 2)
        place *= size
        place += np.arange(size, dtype=np.int32)[:, None]
        shares = np.broadcast_to(share, place.shape)
        move = np.bincount(place.ravel(), shares.ravel(), len(levels) * (width + 2) * size).reshape(len(levels), width + 2, size)
        short = -np.einsum("lij,ij->li", np.minimum(left, 0.0, out=left), share)
        cost = -shortage * short - holding * levels[:, None] / 2.0
        return cost, (move[:, :width], move[:, width], move[:, width + 1], up)

    def ahead(move: tuple, value: np.ndarray) -> np.ndarray:
        """Mean of ``value`` (states, .., items) over where each level leads."""
        falls, low, high, up = move
        out = low.reshape(len(levels), *[1] * (value.ndim - 2), -1) * value[0] + high.reshape(len(levels), *[1] * (value.ndim - 2), -1) * value[last]
        for k in range(falls.shape[1]):
            fall = k - up
            # from a level to the state `fall` below it, the bottom apart
            first, end = max(fall, 0), min(len(levels), len(states) + fall)
            out[first:end] += falls[first:end, k].reshape(end - first, *[1] * (value.ndim - 2), -1) * value[first - fall : end - fall]
        return out

    def dense(cost: np.ndarray, move: tuple, order: np.ndarray) -> np.ndarray:
        """Values of a policy by the equations of all states."""
        each, at = np.arange(cost.shape[1]), here[:, None] + order
        steps = ahead(move, np.broadcast_to(np.eye(len(states))[:, :, None], (len(states), len(states), len(each))))
        steps = steps[at, :, each].transpose(1, 0, 2)
        gain = (cost[at, each] - fixed * (order > 0)).T
        return np.linalg.solve(np.eye(len(states)) - gamma * steps, gain[:, :, None])[:, :, 0].T

    def evaluate(cost: np.ndarray, move: tuple, order: np.ndarray) -> np.ndarray:
        """Values (states, items) of a policy.

        Without returns a state that orders nothing leads to lower ones only, and one that orders is worth what the level
        it orders up to is: so values are a forward substitution in terms of the levels ordered up to, which are few as a
        rule, and the equations are those of these levels.
        """
        falls, low, high, up = move
        size = cost.shape[1]
        each, at, orders = np.arange(size), here[:, None] + order, order > 0
        reached = np.zeros((len(levels), size), bool)
        state, item = np.nonzero(orders)
        reached[at[state, item], item] = True
        number = np.cumsum(reached, axis=0) - 1
        many = int(reached.sum(axis=0).max(initial=0))
        if up:
            return dense(cost, move, order)
        terms = np.zeros((len(states), 1 + many, size))
        terms[:, 0] = np.where(orders, -fixed, cost[: len(states)])
        terms[state, 1 + number[at[state, item], item], item] = 1.0
        stays = 1.0 / (1.0 - gamma * np.where(here[:, None] == 0, low[: len(states)], falls[: len(states), 0]))
        for s in range(len(states)):
            found = terms[s]
            if s:
                found = found + gamma * low[s] * terms[0]
                n = min(falls.shape[1] - 1, s)
                if n:
                    found += gamma * np.einsum("ki,kmi->mi", falls[s, 1 : n + 1], terms[s - n : s][::-1])
            terms[s] = np.where(orders[s], terms[s], found * stays[s])
        if not many:
            return terms[:, 0]
        # the levels ordered up to, ascending; an item with fewer has empty equations
        level, item = np.nonzero(reached)
        slot = number[level, item]
        worth = ahead_of(move, terms, level, item)
        a, b = np.broadcast_to(np.eye(many), (size, many, many)).copy(), np.zeros((size, many))
        a[item, slot] -= gamma * worth[:, 1:]
        b[item, slot] = cost[level, item] + gamma * worth[:, 0]
        known = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        return terms[:, 0] + np.einsum("smi,im->si", terms[:, 1:], known)

    def ahead_of(move: tuple, terms: np.ndarray, level: np.ndarray, item: np.ndarray) -> np.ndarray:
        """(places, terms): as :func:`ahead`, of single levels of items."""
        falls, low, high, _ = move
        out = low[level, item][:, None] * terms[0, :, item] + high[level, item][:, None] * terms[last, :, item]
        for k in range(falls.shape[1]):
            share = np.where((level >= k) & (level - k <= last), falls[level, k, item], 0.0)
            out += share[:, None] * terms[(level - k).clip(0, last), :, item]
        return out

    def solve(demands: list, counts: list):
        cost, move = transitions(demands, counts)
        size = len(demands)
        order = np.zeros((len(states), size), int)
        rounds, open_ = np.zeros(size, int), np.ones(size, bool)
        each = np.arange(size)
        for number in range(1, params.policy_rounds + 1):
            value = evaluate(cost, move, order)
            by_level = cost + gamma * ahead(move, value)
            # all orders of a state: its own level, or any of the levels above for the fixed cost
            best, wide, span = by_level[: len(states)], len(actions) - 1, 1
            if wide:
                reach = by_level[1:]
                while 2 * span <= wide:
                    reach, span = np.maximum(reach[:-span], reach[span:]), 2 * span
                best = np.maximum(best, np.maximum(reach[: len(states)], reach[wide - span :]) - fixed)
            same = best <= by_level[here[:, None] + order, each] - fixed * (order > 0) + SAME
            rounds[open_] = number
            open_ = ~same.all(axis=0)
            # the smallest order as good as the best: of states that change, or of all once nothing does
            ended = not open_.any()
            state, item = np.nonzero(np.ones_like(same) if ended else open_ & ~same)
            choices = by_level[state[:, None] + np.arange(len(actions)), item[:, None]] - fixed * (actions > 0)
            order[state, item] = (choices >= best[state, item][:, None] - SAME).argmax(axis=1)
            if ended:
                break
        return value.T, order.T, rounds, ~open_

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                own = batch.iloc[at : at + BLOCK]
                value, order, rounds, converged = solve(own["demands"].tolist(), own["counts"].tolist())
                yield pd.DataFrame(
                    {
                        "medicine_id": np.repeat(own["medicine_id"].to_numpy(), len(states)),
                        "stock_level": np.tile(states, len(own)),
                        "order_quantity": actions[order.ravel()],
                        "value": value.ravel(),
                        "rounds": np.repeat(rounds, len(states)),
                        "converged": np.repeat(converged, len(states)),
                    }
                )

    kind = histograms.schema["medicine_id"].dataType.simpleString()
    schema = f"medicine_id {kind}, stock_level bigint, order_quantity bigint, value double, rounds bigint, converged boolean"
    return spread_by_item(histograms.select("medicine_id", "demands", "counts")).mapInPandas(per_batch, schema)


def bellman_residual(histograms: DataFrame, policy: DataFrame, params: Params = Params()) -> DataFrame:
    """(medicine_id, residual): the largest gap between a value and the best that one step from it can give.

    Worked out from each item's demands one by one, apart from the solver's matrices. An item's values are put together
    in one row and joined with its histogram; levels and orders are laid out inside a task, never as rows.
    """
    step, top, most = params.policy_step, params.policy_max_stock, params.policy_max_order
    states, levels = np.arange(0, top + 1, step), np.arange(0, top + most + 1, step)
    wide = most // step
    pairs = F.sort_array(F.collect_list(F.struct("stock_level", "value")))
    known = policy.filter("stock_level is not null").groupBy("medicine_id").agg(pairs["stock_level"].alias("at"), pairs["value"].alias("values"))
    joined = histograms.select("medicine_id", "demands", "counts").join(known, "medicine_id")

    def gap(demands: np.ndarray, counts: np.ndarray, at: np.ndarray, values: np.ndarray) -> float | None:
        share = counts / counts.sum()
        value, has = np.full(len(states), np.nan), np.zeros(len(states), bool)
        place = at // step
        value[place], has[place] = values, True
        left = levels[:, None] - demands
        # an unknown demand is as one that leaves the highest level
        inside = np.where(np.isnan(left), top, np.clip(left, 0, top))
        following = np.maximum(np.ceil(inside / step - 0.5), 0).astype(np.int64)
        short = np.where(left < 0, -left, 0.0)
        reached = has[following]
        one = np.where(reached, share * (params.policy_discount * value[following] - params.shortage_cost * short), 0.0)
        ahead = np.where(reached.any(axis=1), one.sum(axis=1) - params.holding_cost * levels / 2, -np.inf)
        tried = sliding_window_view(np.append(ahead, np.full(wide, -np.inf)), wide + 1)[: len(states)].copy()
        tried[:, 1:] -= params.order_cost
        best = tried.max(axis=1)
        asked = has & (best != -np.inf)
        return float(np.abs(value - best)[asked].max()) if asked.any() else None

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = (batch[c] for c in ("demands", "counts", "at", "values"))
            gaps = [gap(np.asarray(d, float), np.asarray(n, float), np.asarray(a, np.int64), np.asarray(v, float)) for d, n, a, v in zip(*lists)]
            yield pd.DataFrame({"medicine_id": batch["medicine_id"], "residual": pd.array(gaps, dtype="Float64") if None in gaps else gaps})

    kind = histograms.schema["medicine_id"].dataType.simpleString()
    return joined.mapInPandas(per_batch, f"medicine_id {kind}, residual double")


def apply_policy(stock: DataFrame, policy: DataFrame, params: Params = Params()) -> DataFrame:
    """Order size for each item's current stock: nearest grid level, then an equi join on (item, level).

    An item without a policy, or of unknown stock, stays, with no order quantity.
    """
    level = nearest_level(F.col("current_inventory"), params.policy_step, params.policy_max_stock) * params.policy_step
    level = F.when(F.col("current_inventory").isNotNull(), level)
    return stock.withColumn("stock_level", level.cast("bigint")).join(policy, ["medicine_id", "stock_level"], "left")
