"""Small hand-written tables in the shape of the canonical ones."""

import datetime as dt

REPORT_SCHEMA = (
    "id int, make string, make_raw string, model string, model_year int, vehicle_key string, "
    "component struct<raw:string,group:string,levels:array<string>>, miles_at_failure int, "
    "description string, received_date date, crash boolean, fire boolean, injured int, deaths int, "
    "police_report boolean, vehicle_towed boolean, medical_attention boolean"
)
RECALL_SCHEMA = (
    "id int, campaign_number string, manufacturer string, make string, model string, model_year int, "
    "vehicle_key string, component_name string, component_group string, potentially_affected int, "
    "owners_notified_date date, report_received_date date, defect_description string, "
    "consequence string, corrective_action string, do_not_drive boolean, park_outside boolean"
)


def key(make, model, year):
    return f"{make.lower()}|{model.lower()}|{year or 'unknown'}"


def report(
    id, make="OPAL", model="RIVER", year=2015, group="ENGINE", miles=None, year_received=2020, text="",
    top=None, **flags,
):
    given = {
        "crash": False, "fire": False, "injured": 0, "deaths": 0, "police_report": False,
        "vehicle_towed": False, "medical_attention": False, **flags,
    }
    top = group if top is None else top
    return (
        id, make, make.title(), model, year, key(make, model, year), (top, group, [top] if top else []),
        miles, text, dt.date(year_received, 6, 1), *given.values(),
    )


def reports(spark, rows):
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def recall(
    id, campaign, make="OPAL", model="RIVER", year=2015, group="ENGINE", name=None, affected=None,
    day=None, do_not_drive=False, park_outside=False,
):
    return (
        id, campaign, "Maker", make, model, year, key(make, model, year), name or group, group, affected,
        None, day, f"defect {id}", "consequence", "remedy", do_not_drive, park_outside,
    )


def recalls(spark, rows):
    return spark.createDataFrame(rows, RECALL_SCHEMA)


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
