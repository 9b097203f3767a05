"""Derived tables: panel, features, labels, entities, intervals."""

from tidepanel.plans.registry import query, rounded


@query("daily_panel")
def _(d):
    return rounded(d.daily)


@query("daily_panel_supplier", "supplier")
def _(d):
    return rounded(d.daily)


@query("features")
def _(d):
    return rounded(d.features)


@query("features_supplier", "supplier")
def _(d):
    return rounded(d.features)


@query("labels")
def _(d):
    return rounded(d.labels)


@query("labels_supplier", "supplier")
def _(d):
    return rounded(d.labels)


@query("merchants")
def _(d):
    return rounded(d.merchants)


@query("scenario_events")
def _(d):
    return rounded(d.events)
