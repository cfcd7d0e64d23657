"""The registered queries of the core, by family."""


def modules() -> list:
    from plumbline.plans import consistency, evaluation, flows, matching, ordered, relational, statements, structures, texts, verification

    return [consistency, evaluation, flows, matching, ordered, relational, statements, structures, texts, verification]
