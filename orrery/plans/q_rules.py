"""Classifier and rule-join queries over ``customer`` (J14, Q-S, Q-T, A16, O5).

Customers are read as systems: a negative balance means unoccupied,
otherwise the balance sets the control state and the nation the
controlling power; the nation and key pick the two powers in range, the
MACHINERY segment marks a conflict and an open urgent order a stronghold
carrier.  The power acting is a parameter (default Li Yong-Rui).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators.rules import CATEGORY_ORDER, RULES, classify_action, group_by_category, rule_join, rules_df
from orrery.plans.catalog import register
from orrery.plans.q_spatial import POWERS
from orrery.sources.tables import table

POWER = "Li Yong-Rui"


def customer_systems(spark, sf, power=POWER):
    c = table(spark, sf, "customer").alias("c")
    o = table(spark, sf, "orders").alias("o")
    bal = F.col("c_acctbal")
    plist = F.array(*[F.lit(p) for p in POWERS])
    state = (F.when(bal < 0, "Unoccupied").when(bal < 3000, "Exploited")
             .when(bal < 7000, "Fortified").otherwise("Stronghold"))
    carrier = o.where(
        (F.col("o.o_custkey") == F.col("c.c_custkey").outer())
        & (F.col("o.o_orderpriority") == "1-URGENT") & (F.col("o.o_orderstatus") == "O")
    ).exists()
    sys = c.select(
        F.col("c_custkey").alias("system_id"),
        state.alias("state"),
        F.when(bal >= 0, F.element_at(plist, F.pmod("c_nationkey", F.lit(12)) + 1)).alias("controlling_power"),
        F.array(
            F.element_at(plist, F.pmod(F.col("c_nationkey") + 7, F.lit(12)) + 1),
            F.element_at(plist, (F.pmod("c_custkey", F.lit(12)) + 1).cast("int")),
        ).alias("powers"),
        (F.col("c_mktsegment") == "MACHINERY").alias("in_conflict"),
        carrier.alias("has_carrier"),
    )
    return sys.withColumn("action", classify_action(F.col("controlling_power"), F.col("state"), F.col("powers"), power))


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"


def _rules_sql():
    rows = []
    for i, r in enumerate(RULES, 1):
        (act, cat, a, re_, u, legal, carrier, req, ba, br, bu, vul) = r
        rows.append(
            f"({i}, '{act}', '{cat}', {str(a).lower()}, {str(re_).lower()}, {str(u).lower()}, "
            f"{str(legal).lower()}, {str(carrier).lower()}, '{req}', {_sql_list(ba)}, {_sql_list(br)}, "
            f"{_sql_list(bu)}, {_sql_list(vul)})"
        )
    return (
        "rules(rule_id, activity, category, acquisition, reinforcement, undermining, legal, carrier_ok, "
        "requirement, bonus_acquisition, bonus_reinforcement, bonus_undermining, vulnerable) AS (VALUES\n"
        + ",\n".join(rows) + ")"
    )


_SYS_SQL = f"""
  sys AS (
    SELECT c_custkey AS system_id,
           CASE WHEN c_acctbal < 0 THEN 'Unoccupied' WHEN c_acctbal < 3000 THEN 'Exploited'
                WHEN c_acctbal < 7000 THEN 'Fortified' ELSE 'Stronghold' END AS state,
           CASE WHEN c_acctbal >= 0 THEN p[(c_nationkey % 12) + 1] END AS controlling_power,
           [p[((c_nationkey + 7) % 12) + 1], p[(c_custkey % 12) + 1]] AS powers,
           c_mktsegment = 'MACHINERY' AS in_conflict,
           EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                   AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'O') AS has_carrier
    FROM customer c, (SELECT {_sql_list(POWERS)} AS p) pw),
  cls AS (
    SELECT *, CASE WHEN controlling_power = '{POWER}' THEN 'Reinforce'
                   WHEN state = 'Unoccupied' AND coalesce(list_contains(powers, '{POWER}'), false) THEN 'Acquire'
                   WHEN state = 'Unoccupied' THEN 'Out of Range'
                   ELSE 'Undermine' END AS action
    FROM sys)
"""


@register(
    "classify_systems",
    oracle=f"""WITH {_SYS_SQL}
    SELECT system_id, state, controlling_power, in_conflict, has_carrier, action FROM cls""",
)
def classify_systems(spark, sf):
    return customer_systems(spark, sf).drop("powers")


def _rule_join_sql(by_name: bool) -> str:
    lists = "r"
    extra = ""
    if by_name:
        extra = """,
  lastr AS (SELECT activity, bonus_acquisition, bonus_reinforcement, bonus_undermining, vulnerable
            FROM rules WHERE rule_id IN (SELECT max(rule_id) FROM rules GROUP BY activity))"""
        lists = "l"
    cat = _sql_list(CATEGORY_ORDER)
    join_l = " JOIN lastr l ON l.activity = r.activity" if by_name else ""
    return f"""WITH {_rules_sql()},
  rba AS (SELECT *, 'Acquire' AS action FROM rules WHERE acquisition
          UNION ALL SELECT *, 'Reinforce' AS action FROM rules WHERE reinforcement
          UNION ALL SELECT *, 'Undermine' AS action FROM rules WHERE undermining),
  {_SYS_SQL}{extra}
  SELECT s.system_id, s.action, r.rule_id, r.activity, r.category,
         CAST(list_position({cat}, r.category) AS INTEGER) AS category_rank, r.legal,
         CASE WHEN s.controlling_power IS NULL AND s.action = 'Acquire'
                THEN list_contains({lists}.bonus_acquisition, '{POWER}')
              WHEN s.controlling_power = '{POWER}' AND s.action = 'Reinforce'
                THEN list_contains({lists}.bonus_reinforcement, '{POWER}')
              WHEN s.controlling_power IS NOT NULL AND s.controlling_power <> '{POWER}' AND s.action = 'Undermine'
                THEN list_contains({lists}.bonus_undermining, '{POWER}')
              ELSE false END AS bonus,
         CASE WHEN s.controlling_power IS NOT NULL AND s.controlling_power <> '{POWER}' AND s.action = 'Undermine'
                THEN list_contains({lists}.vulnerable, s.controlling_power) ELSE false END AS vulnerable
  FROM cls s JOIN rba r ON s.action = r.action{join_l}
  WHERE (CASE r.requirement
           WHEN 'archon_if_undermine' THEN s.action <> 'Undermine' OR coalesce(s.controlling_power = 'Archon Delaine', false)
           WHEN 'conflict_if_acquire' THEN s.action <> 'Acquire' OR s.in_conflict
           ELSE true END)
    AND (NOT (s.action = 'Undermine' AND s.has_carrier) OR r.carrier_ok)
"""


@register("rule_join", oracle=_rule_join_sql(False), headline=True)
def rule_join_q(spark, sf):
    return rule_join(customer_systems(spark, sf), rules_df(spark), POWER)


@register("rule_join_by_name", oracle=_rule_join_sql(True))
def rule_join_by_name(spark, sf):
    return rule_join(customer_systems(spark, sf), rules_df(spark), POWER, by_name=True)


@register(
    "activities_by_category",
    oracle=f"""
    WITH applied AS ({_rule_join_sql(False)})
    SELECT system_id, action, category, category_rank,
           array_to_string(list_transform(list_sort(array_agg((rule_id, activity))), lambda x: x[2]), '|')
             AS activities,
           count(*) AS n_rules, bool_or(bonus) AS any_bonus
    FROM applied GROUP BY system_id, action, category, category_rank
    """,
)
def activities_by_category(spark, sf):
    applied = rule_join(customer_systems(spark, sf), rules_df(spark), POWER)
    return group_by_category(applied)
