"""Table shapes of the code-graph model; explicit, never inferred."""

from __future__ import annotations


def table(spec: str) -> str:
    """A shape as DDL on one line; readers and from_json take it as it is, and no session is needed to name it."""
    return " ".join(spec.split())


#: A class-diagram document: elements, relationships.
UML = table(
    "elements array<struct<id:string,name:string,display_name:string,namespace:string,is_abstract:boolean,type:string,"
    "source_location:struct<file:string,line:int>,members:array<struct<name:string,source_location:struct<file:string,line:int>>>,"
    "template_parameters:array<struct<type:string,name:string>>>>, "
    "relationships array<struct<type:string,source:string,destination:string,label:string>>, metadata string"
)

#: Collector vocabulary to edge kinds: aggregation and association shift by one, extension splits later, containment is dropped.
KIND_MAP = {"extension": "inheritance", "aggregation": "composition", "association": "aggregation", "dependency": "dependency", "friendship": "friendship", "instantiation": "instantiation"}
EXTERNAL = "__external__"
