"""Columns over the JSON of templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a template's JSON that name other templates; what is nested deeper stays JSON text.
REFERRING = "action_imports MAP<STRING, STRING>, expected_inputs ARRAY<STRING>, expected_outputs ARRAY<STRING>, instantiation_layouts ARRAY<STRUCT<child_templates: ARRAY<STRING>>>"


def _codes(c: Column) -> Column:
    """Codes that one JSON object names: keys of the actions of a group or the group itself, inputs,
    outputs, and the children of layouts, which are texts or objects with a template_code."""
    none = F.array().cast("array<string>")
    nested = lambda v: F.ltrim(v).startswith("{")
    groups = F.coalesce(F.map_values(c["action_imports"]), none)
    actions = F.flatten(F.transform(groups, lambda v: F.when(nested(v), F.coalesce(F.json_object_keys(F.get_json_object(v, "$.actions")), none)).otherwise(F.array(v))))
    layouts = F.coalesce(c["instantiation_layouts"], F.array().cast("array<struct<child_templates:array<string>>>"))
    children = F.flatten(F.transform(layouts, lambda x: F.coalesce(x["child_templates"], none)))
    children = F.transform(children, lambda v: F.when(nested(v), F.get_json_object(v, "$.template_code")).otherwise(v))
    return F.concat(actions, F.coalesce(c["expected_inputs"], none), F.coalesce(c["expected_outputs"], none), children)


def extracted_refs(json: Column) -> Column:
    """The template codes that a template's JSON names, at its top level and in its json_addl; repeats stay."""

    def refs(text: Column) -> Column:
        levels = F.array(F.from_json(text, REFERRING), F.from_json(F.coalesce(F.get_json_object(text, "$.json_addl"), F.lit("{}")), REFERRING))
        return F.flatten(F.transform(levels, _codes))

    # A lambda's variable is computed once; a plain expression would be parsed again wherever _codes names it.
    return F.array_compact(F.flatten(F.transform(F.array(json), refs)))
