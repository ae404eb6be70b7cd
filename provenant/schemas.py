"""Schemas of the tables; nothing is inferred."""

CLAUSE_FIELDS = (
    "clause_id string, citation string, part_number string, part_title string, section_number string, "
    "section_title string, text string, `order` int, line_start int, line_end int, source string, "
    "effective_from date, effective_to date, amendment_id string, amendment_paragraph string, "
    "is_amended_version boolean, date_condition_type string"
)
CLAUSES = CLAUSE_FIELDS + ", pos int"

SUBSTITUTION = "paragraph string, target_clause_id string, find_text string, replace_text string, replace_all boolean, category string, transitional_ref string, date_condition_type string"
TABLE = "paragraph string, target_clause_id string, new_table string, category string, transitional_ref string, date_condition_type string"
INSERTION = "paragraph string, new_clause_id string, after_clause_id string, text string, category string, transitional_ref string, date_condition_type string"
PROVISION = "provision_id string, text string, applies_to_categories array<string>, date_condition_type string"
QUESTIONS = "id string, category string, question string, expected_behavior string, expected_clauses array<string>"


def struct_fields(ddl: str) -> str:
    """``a int, b string`` as the fields of a struct: ``a:int,b:string``."""
    return ",".join(":".join(part.strip().split(" ", 1)) for part in ddl.split(", "))


AMENDMENT = (
    "amendment_id string, issued_date date, effective_date date, source_file string, "
    f"substitutions array<struct<{struct_fields(SUBSTITUTION)}>>, table_replacements array<struct<{struct_fields(TABLE)}>>, "
    f"insertions array<struct<{struct_fields(INSERTION)}>>, transitional_provisions array<struct<{struct_fields(PROVISION)}>>"
)
