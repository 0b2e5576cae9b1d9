"""Profile preparation: normalise, validate, derive, warn, completeness, long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import cells


def normalise(profiles: DataFrame) -> DataFrame:
    """State to upper case, gender to lower, caste upper, trimmed and alias-resolved."""
    aliases = F.create_map(*[F.lit(x) for kv in model.CASTE_ALIASES.items() for x in kv])
    caste = F.trim(F.upper("applicant_caste_category"))
    return profiles.withColumns(
        {
            "location_state": F.upper("location_state"),
            "applicant_gender": F.lower("applicant_gender"),
            "applicant_caste_category": F.coalesce(F.try_element_at(aliases, caste), caste),
        }
    )


def validation_errors() -> Column:
    """Reasons for rejecting a profile; an unknown caste only warns."""
    age, gender, state = F.col("applicant_age"), F.col("applicant_gender"), F.col("location_state")
    return F.array_compact(
        F.array(
            F.when(~age.between(0, 120), F.lit("age out of range")),
            F.when(~gender.isin(*model.GENDERS), F.lit("unknown gender")),
            F.when(~state.isin(*model.STATE_CODES), F.lit("unknown state")),
        )
    )


def validate(profiles: DataFrame) -> DataFrame:
    """Good and rejected profiles in one pass: `errors` is empty for good ones."""
    return profiles.withColumns(
        {
            "errors": validation_errors(),
            "caste_warning": F.coalesce(
                ~F.col("applicant_caste_category").isin(*model.CASTE_CATEGORIES), F.lit(False)
            ),
        }
    )


def derive_annual_income(profiles: DataFrame) -> DataFrame:
    """Annual income falls back to twelve months; remembers that it did."""
    annual, monthly = F.col("household_income_annual"), F.col("household_income_monthly")
    return profiles.withColumns(
        {
            "income_derived": annual.isNull() & monthly.isNotNull(),
            "household_income_annual": F.coalesce(annual, monthly * 12),
        }
    )


def warnings() -> Column:
    """The six cross-field warnings; needs `income_derived` from derive_annual_income."""
    annual, monthly = F.col("household_income_annual"), F.col("household_income_monthly")
    mismatch = F.abs(monthly * 12 - annual) / annual
    return F.array_compact(
        F.array(
            F.when(F.col("income_derived"), F.lit("income_auto_computed")),
            F.when(
                ~F.col("income_derived") & (annual > 0) & (mismatch > 0.20),
                F.lit("income_inconsistent"),
            ),
            F.when(
                F.col("applicant_disability_status") & F.col("applicant_disability_percentage").isNull(),
                F.lit("disability_percentage_missing"),
            ),
            F.when(
                ~F.col("documents_bank_account") & F.col("documents_bank_account_type").isNotNull(),
                F.lit("bank_type_without_account"),
            ),
            F.when(
                F.col("employment_is_income_tax_payer") & (annual < 250000),
                F.lit("taxpayer_below_threshold"),
            ),
            F.when(F.col("applicant_age") < 18, F.lit("minor")),
        )
    )


def with_cells(profiles: DataFrame, extras: dict[str, str] | None = None) -> DataFrame:
    """Profile as one array of cells in field order, plus a map for unmapped fields."""
    ordered = [cells.cell(F.col(model.column_of(p)), kind) for p, kind in model.PROFILE_FIELDS]
    extra_items = [
        x
        for path, column in (extras or {}).items()
        for x in (F.lit(path), cells.cell(F.col(column), "str"))
    ]
    extra_map = F.create_map(*extra_items) if extra_items else F.create_map().cast(f"map<string,{cells.CELL}>")
    return profiles.select(
        "profile_id",
        F.coalesce("location_state", F.lit("*")).alias("state"),
        F.array(*ordered).alias("cells"),
        extra_map.alias("extras"),
    ).withColumn("populated", populated_slots(F.col("cells")))


def populated_slots(cell_array: Column) -> Column:
    """Slots of the fields a profile fills, worked out once per profile."""
    numbered = F.transform(cell_array, lambda c, i: F.when(populated(c), i))
    return F.array_compact(numbered)


def lookup(cell_array: Column, extras: Column, slot: Column, field: Column) -> Column:
    """Cell of a field: by slot when mapped, else from the extras."""
    found = F.when(slot.isNotNull(), F.try_element_at(cell_array, slot + 1)).otherwise(
        F.try_element_at(extras, field)
    )
    return F.coalesce(found, cells.null_cell())


def populated(cell: Column) -> Column:
    return (cell["kind"] != "null") & ~((cell["kind"] == "list") & (F.size(cell["a"]) == 0))


def long_fields(with_cell_arrays: DataFrame) -> DataFrame:
    """(profile_id, field, cell) rows for mapped and extra fields."""
    names = F.array(*[F.lit(p) for p, _ in model.PROFILE_FIELDS])
    mapped = F.transform(
        F.arrays_zip(names.alias("field"), F.col("cells").alias("cell")),
        lambda z: F.struct(z["field"].alias("field"), z["cell"].alias("cell"), F.lit(True).alias("mapped")),
    )
    extra = F.transform(
        F.map_entries("extras"),
        lambda e: F.struct(e["key"].alias("field"), e["value"].alias("cell"), F.lit(False).alias("mapped")),
    )
    return with_cell_arrays.select(
        "profile_id", F.inline(F.concat(mapped, extra))
    )


def populated_fields(with_cell_arrays: DataFrame) -> DataFrame:
    """Non-null, non-empty mapped fields; extras never count."""
    rows = long_fields(with_cell_arrays)
    return rows.where(F.col("mapped") & populated(F.col("cell"))).select("profile_id", "field")


def completeness(with_cell_arrays: DataFrame, required: list[str] | Column) -> DataFrame:
    """Present / required, sorted missing fields and the impact band."""
    if not isinstance(required, Column):
        required = F.array(*[F.lit(f) for f in sorted(set(required))])
    names = F.array(*[F.lit(p) for p, _ in model.PROFILE_FIELDS])
    present_names = F.transform(
        F.filter(
            F.arrays_zip(names.alias("field"), F.col("cells").alias("cell")),
            lambda z: populated(z["cell"]),
        ),
        lambda z: z["field"],
    )
    present = F.size(F.array_intersect("required", "have"))
    score = F.when(F.size("required") == 0, 0.0).otherwise(present / F.size("required"))
    return (
        with_cell_arrays.withColumns({"required": required, "have": present_names})
        .withColumns(
            {
                "total_relevant_fields": F.size("required"),
                "populated_fields": present,
                "missing_fields": F.array_sort(F.array_except("required", "have")),
                "completeness_score": score,
            }
        )
        .withColumn(
            "impact",
            F.when(F.col("completeness_score") >= 1.0, "complete")
            .when(F.col("completeness_score") >= model.PROFILE_COMPLETE_THRESHOLD, "partial")
            .otherwise("insufficient"),
        )
        .drop("required", "have", "cells", "extras")
    )


def profile_hash(profiles: DataFrame, columns: list[str]) -> Column:
    """SHA-256 over the profile's columns in name order; no raw value leaves.

    Every value is written as a tag, its length and its text, a list as its size and its
    elements in order, so different profiles never have one text.
    """
    kinds = dict(profiles.dtypes)
    sized = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)

    def written(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), kinds[name]
        if kind.startswith("array"):
            items = F.transform(c, lambda x: F.coalesce(sized(x.cast("string")), F.lit("n")))
            text = F.concat(F.lit("l"), F.size(c).cast("string"), F.lit(":"), F.array_join(items, ""))
        elif kind in ("double", "float"):
            text = F.concat(F.lit("s"), sized(c.cast("decimal(38,6)").cast("string")))
        else:
            text = F.concat(F.lit("s"), sized(c.cast("string")))
        return F.concat(F.lit(name + "="), F.when(c.isNull(), F.lit("n")).otherwise(text))

    return F.sha2(F.concat(*[written(c) for c in sorted(columns)]), 256)
