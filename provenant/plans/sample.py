"""A small made-up manual with one amendment, for the demonstration query and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import sources

MANUAL = """# Harbour Moorings Scheme

Front matter that belongs to no clause.

---

# Part 1 — Scope and terms

## 1.1 Purpose of the scheme

**1.1.1** The scheme grants seasonal berths to owners of small working boats in the estuary.

**1.1.2** The harbour office administers the scheme through three wharf stations.

## 1.2 Terms

**1.2.1 Working boat** — a vessel under twelve metres that lands a registered catch.

**1.2.2 Berth fee** — the sum due for each month in which a berth is held.

# Part 2 - Admission

## 2.1 Who may hold a berth

**2.1.1** An owner qualifies for a berth if:

(a) the vessel is registered in the estuary; and

(b) the vessel passed a hull inspection within the last **24 months**.

**2.1.2** Apprentice skippers enrolled at the navigation school are dealt with under a separate provision (see §7.1).

**2.1.3** Whether a visiting yacht may raft alongside a berth holder is addressed separately.

## 2.2 Hull inspection

**2.2.1** A surveyor inspects the hull and keel and records the thickness of the planking.

**2.2.2** An inspection certificate lapses after 24 months unless the surveyor extends it.

# Part 4 — Duties of holders

## 4.3 Reporting duties

**4.3.1** A holder keeps the insurance certificate on board.

**4.3.2** A holder must report a change of ownership to the harbour office within **10 calendar days** of the change.

**4.3.3** The reporting period is extended to 21 calendar days where a storm closes the wharf.

# Part 6 — Fees

## 6.4 Fee relief

**6.4.1** In setting the berth fee, the first $120 of monthly towing income is disregarded.

**6.4.2** Relief ends when the towing licence ends.

## 6.6 Fee table

**6.6.1** The monthly berth fee is set by length:

| Length | Fee |
|---|---|
| up to 6 m | $1,180 |
| over 6 m | $1,460 |

# Part 7 — Dry dock

## 7.1 Slipway bookings

**7.1.1** Slipway bookings open each winter and are allotted by drawing lots.

**7.1.2** A booking not taken up by noon is offered to the next name on the list.

# Part 9 — Penalties

## 9.1 Late notices

**9.1.1** A penalty applies where a holder does not give notice in time.

**9.1.4** A notice given after the 30 days required under §4.3 is late, and a change of ownership reported late incurs a penalty.

# Part 10 — Suspension

## 10.5 Length of suspension

**10.5.2** On a first breach, the berth fee rises by 20 per cent for one month as a sanction.

**10.5.3** A second breach ends the berth.

---

End of the consolidated text.
"""

AMENDMENT = {
    "amendment_id": "2026-01", "issued_date": "2026-02-12", "effective_date": "2026-03-01",
    "source_file": "Amendment No. 2026-01.md",
    "substitutions": [
        {
            "paragraph": "2.1", "target_clause_id": "6.4.1", "find_text": "$120", "replace_text": "$175",
            "replace_all": True, "category": "fees", "transitional_ref": "5.1",
            "date_condition_type": "determination_date"
        },
        {
            "paragraph": "2.2", "target_clause_id": "4.3.2", "find_text": "10 calendar days",
            "replace_text": "14 calendar days", "replace_all": True, "category": "reporting", "transitional_ref": "5.2",
            "date_condition_type": "change_date"
        },
        {
            "paragraph": "2.3", "target_clause_id": "9.1.4", "find_text": "30 days", "replace_text": "14 days",
            "replace_all": True, "category": "reporting", "transitional_ref": "5.2",
            "date_condition_type": "change_date"
        },
        {
            "paragraph": "2.4", "target_clause_id": "10.5.2", "find_text": "20 per cent", "replace_text": "15 per cent",
            "replace_all": False, "category": "sanctions", "transitional_ref": "5.1",
            "date_condition_type": "determination_date"
        },
    ],
    "table_replacements": [
        {
            "paragraph": "3.1", "target_clause_id": "6.6.1",
            "new_table": "| Length | Fee |\n|---|---|\n| up to 6 m | $1,225 |\n| over 6 m | $1,510 |",
            "category": "fees", "transitional_ref": "5.1", "date_condition_type": "determination_date"
        },
    ],
    "insertions": [
        {
            "paragraph": "4.1", "new_clause_id": "10.5.3A", "after_clause_id": "10.5.3",
            "text": "A suspension is waived where the breach was caused by a rescue at sea.", "category": "sanctions",
            "transitional_ref": "5.1", "date_condition_type": "determination_date"
        },
    ],
    "transitional_provisions": [
        {
            "provision_id": "5.1",
            "text": "Amended amounts apply to determinations made on or after the effective date.",
            "applies_to_categories": ["fees", "sanctions"], "date_condition_type": "determination_date"
        },
        {
            "provision_id": "5.2",
            "text": "The amended reporting period applies to changes occurring on or after the effective date.",
            "applies_to_categories": ["reporting"], "date_condition_type": "change_date"
        },
        {
            "provision_id": "5.3", "text": "A period that spans the effective date is apportioned by day.",
            "applies_to_categories": ["fees"], "date_condition_type": None
        },
    ],
}

QUESTIONS = [
    ("direct", "What sum is the berth fee due for each month?"),
    ("terms", "What is a working boat?"),
    ("out", "Which choir performs the opera on Friday evening?"),
    ("undated", "How many days does a holder have to report a change of ownership?"),
    ("before", "How many days does a holder have to report a change of ownership occurring on 20 February 2026?"),
    ("after", "How many days does a holder have to report a change of ownership occurring on 5 March 2026?"),
    ("towing_before", "How much monthly towing income is disregarded for a determination made on 10 February 2026?"),
    ("towing_after", "How much monthly towing income is disregarded for a determination made on 10 March 2026?"),
    ("gap", "Are apprentice skippers enrolled at the navigation school admitted?"),
    ("bare", "May a visiting yacht raft alongside a berth holder?"),
    ("rescue", "Is a suspension waived for a breach caused by a rescue at sea, determination made on 10 April 2026?"),
    (
        "span",
        "What is the monthly berth fee by length for a claim period running from 15 February 2026 to 15 March 2026?"
    ),
]


def clauses(spark: SparkSession) -> DataFrame:
    return sources.clause_table(spark.createDataFrame([("manual.md", MANUAL)], "source string, text string"))


def specs(spark: SparkSession) -> DataFrame:
    return sources.amendments(spark, [AMENDMENT])


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid string, question string")
