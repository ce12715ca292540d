"""Vocabulary of RDF, RDFS, OWL and SKOS terms and what they mean for an entity graph (fixed values)."""

from __future__ import annotations

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DCTERMS = "http://purl.org/dc/terms/"
DC = "http://purl.org/dc/elements/1.1/"
TYPE = RDF + "type"
THING = OWL + "Thing"
SUBCLASS = RDFS + "subClassOf"

#: Node kinds, most specific first.
KINDS = ("ontology", "class", "objectProperty", "datatypeProperty", "annotationProperty", "property", "conceptScheme", "collection", "concept", "individual", "other")

TYPE_KINDS = {
    OWL + "Ontology": "ontology",
    OWL + "Class": "class",
    RDFS + "Class": "class",
    RDFS + "Datatype": "class",
    OWL + "ObjectProperty": "objectProperty",
    OWL + "DatatypeProperty": "datatypeProperty",
    OWL + "AnnotationProperty": "annotationProperty",
    OWL + "TransitiveProperty": "objectProperty",
    OWL + "SymmetricProperty": "objectProperty",
    OWL + "FunctionalProperty": "property",
    OWL + "InverseFunctionalProperty": "objectProperty",
    RDF + "Property": "property",
    SKOS + "Concept": "concept",
    SKOS + "ConceptScheme": "conceptScheme",
    SKOS + "Collection": "collection",
    SKOS + "OrderedCollection": "collection",
    OWL + "NamedIndividual": "individual",
}

LABELS = (SKOS + "prefLabel", RDFS + "label", DCTERMS + "title", DC + "title")
DESCRIPTIONS = (RDFS + "comment", SKOS + "definition", DCTERMS + "description", DC + "description")

#: Predicates drawn as edges: kind, and whether the ends are swapped.
EDGE_KINDS = {
    RDFS + "subClassOf": ("subClassOf", False),
    RDFS + "subPropertyOf": ("subPropertyOf", False),
    RDFS + "domain": ("domain", False),
    RDFS + "range": ("range", False),
    OWL + "equivalentClass": ("equivalentClass", False),
    OWL + "equivalentProperty": ("equivalentProperty", False),
    OWL + "disjointWith": ("disjointWith", False),
    OWL + "inverseOf": ("inverseOf", False),
    OWL + "sameAs": ("sameAs", False),
    SKOS + "broader": ("broader", False),
    SKOS + "related": ("related", False),
    SKOS + "inScheme": ("inScheme", False),
    SKOS + "topConceptOf": ("inScheme", False),
    SKOS + "member": ("member", False),
    RDFS + "seeAlso": ("seeAlso", False),
    SKOS + "narrower": ("broader", True),
    SKOS + "hasTopConcept": ("inScheme", True),
}

#: Kinds that a predicate implies for both of its ends.
IMPLIED_KINDS = {
    RDFS + "subClassOf": "class",
    RDFS + "subPropertyOf": "property",
    SKOS + "broader": "concept",
    SKOS + "related": "concept",
    SKOS + "narrower": "concept",
}

META_CLASSES = tuple(
    [OWL + n for n in ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "FunctionalProperty", "InverseFunctionalProperty", "TransitiveProperty", "SymmetricProperty", "ReflexiveProperty", "IrreflexiveProperty", "AsymmetricProperty", "Ontology", "NamedIndividual", "Restriction", "Thing")]
    + [RDF + n for n in ("Property", "List")]
    + [RDFS + n for n in ("Class", "Datatype", "Resource", "Container", "ContainerMembershipProperty")]
)

SCHEMA_PREDICATES = tuple(
    [RDF + n for n in ("type", "first", "rest")]
    + [RDFS + n for n in ("subClassOf", "subPropertyOf", "domain", "range", "isDefinedBy")]
    + [OWL + n for n in ("equivalentClass", "equivalentProperty", "disjointWith", "inverseOf", "imports", "onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "unionOf", "intersectionOf", "complementOf", "oneOf", "versionInfo")]
)

CLASS_KINDS = {SKOS + "Concept": "concept", SKOS + "ConceptScheme": "conceptScheme", SKOS + "Collection": "collection", SKOS + "OrderedCollection": "collection"}
NUMERIC = tuple(XSD + n for n in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
OMITTED_TYPES = tuple(OWL + n for n in ("Restriction", "FunctionalProperty", "InverseFunctionalProperty", "TransitiveProperty", "SymmetricProperty", "AllDisjointClasses", "AllDisjointProperties"))
OMITTED_PREDICATES = tuple(OWL + n for n in ("disjointWith", "unionOf", "intersectionOf", "propertyChainAxiom", "hasKey"))

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS, "xsd": XSD, "dcterms": DCTERMS}
