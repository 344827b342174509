"""The fixed lookups as SPARQL text, for whoever wants to see or vary them."""

from __future__ import annotations

from lattica.operators import lookups as ops
from lattica.plans.model import Vocabulary


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'


class Texts:
    def __init__(self, vocabulary: Vocabulary = Vocabulary()):
        self.v, self.p = vocabulary, vocabulary.prefix

    def fact(self, kind: str, source: str, target: str) -> str:
        p = self.p
        kind = kind if kind.startswith("?") else f"{p}:{kind}"
        return f"[ a {p}:Relation ; {p}:relationType {kind} ; {p}:sourceEntity {source} ; {p}:targetEntity {target} ] ."

    def named(self, name: str, node: str = "?person", label: str = "?label", cls: str | None = "Person", both: bool = True, cap: int | None = ops.CANDIDATES) -> str:
        q = quoted(name)
        test = f"CONTAINS(STR({label}), {q})" + (f" || CONTAINS({q}, STR({label}))" if both else "")
        of = f"a {self.p}:{cls} ; " if cls else ""
        body = f"{node} {of}rdfs:label {label} . FILTER({test})"
        return body if cap is None else f"{{ SELECT DISTINCT {node} {label} WHERE {{ {body} }} LIMIT {cap} }}"

    def shown(self, node: str, label: str) -> str:
        return f"OPTIONAL {{ {node} rdfs:label {label}Raw }} BIND(COALESCE({label}Raw, STR({node})) AS {label})"

    def select(self, columns: str, body: str, limit: int, distinct: bool = True) -> str:
        return f"{self.v.header()}\nSELECT {'DISTINCT ' if distinct else ''}{columns} WHERE {{\n{body}\n}} LIMIT {limit}"

    # the lookups
    def person_labels(self, name: str) -> str:
        return self.select("?person ?label", self.named(name, both=False, cap=None), 20)

    def _name(self, name: str, relation: str, kind: str) -> str:
        node, label = f"?{kind}Node", f"?{kind}Label"
        body = f"{self.named(name)} {self.fact(relation, '?person', node)} OPTIONAL {{ {node} rdfs:label {label} }} BIND(COALESCE({label}, STR({node})) AS ?{kind}Name)"
        return self.select(f"?person ?label {node} {label} ?{kind}Name", body, 30)

    def courtesy_name(self, name: str) -> str:
        return self._name(name, "hasCourtesyName", "courtesy")

    def art_name(self, name: str) -> str:
        return self._name(name, "hasArtName", "art")

    def _year(self, relation: str, out: str, inside: str = "") -> str:
        p = self.p
        arms = f"{{ {self.fact(relation, '?person', f'?{out}Node')} {self.shown(f'?{out}Node', f'?{out}Item')} }} UNION {{ ?person {p}:{relation} ?{out}Lit . FILTER(isLiteral(?{out}Lit)) BIND(STR(?{out}Lit) AS ?{out}Item) }}"
        return f'OPTIONAL {{ {{ SELECT ?person (GROUP_CONCAT(DISTINCT ?{out}Item; separator=" / ") AS ?{out}) WHERE {{ {inside} {arms} }} GROUP BY ?person }} }}'

    def birth_death(self, name: str) -> str:
        people = self.named(name)
        return self.select("?person ?label ?birthYear ?deathYear", f"{people} {self._year('bornIn', 'birthYear', people)} {self._year('diedIn', 'deathYear', people)}", 20, False)

    def _simple(self, name: str, relation: str, value: str) -> str:
        body = f"{self.named(name)} {self.fact(relation, '?person', f'?{value}')} {self.shown(f'?{value}', f'?{value}Label')}"
        return self.select(f"?person ?label ?{value} ?{value}Label", body, 30)

    def teacher_relations(self, name: str) -> str:
        return self._simple(name, "hasTeacher", "teacher")

    def school_membership(self, name: str) -> str:
        return self._simple(name, "belongsToSchool", "school")

    def family_relations(self, name: str) -> str:
        arm = lambda s, t, tag: f'{{ {self.fact("fatherOf", s, t)} BIND("{tag}" AS ?relationType) }}'
        body = f"{self.named(name)} {arm('?person', '?relative', ops.CHILD)} UNION {arm('?relative', '?person', ops.PARENT)} {self.shown('?relative', '?relativeLabel')}"
        return self.select("?person ?label ?relative ?relativeLabel ?relationType", body, 40)

    def social_relations(self, name: str) -> str:
        arms = f"{{ {self.fact('hasFriend', '?person', '?friend')} }} UNION {{ {self.fact('hasFriend', '?friend', '?person')} }}"
        return self.select("?person ?label ?friend ?friendLabel", f"{self.named(name)} {arms} {self.shown('?friend', '?friendLabel')}", 30)

    def school_founder(self, name: str) -> str:
        body = f"{self.named(name, '?school', '?schoolLabel', None)} {self.fact('foundsSchool', '?founder', '?school')} {self.shown('?founder', '?founderLabel')}"
        return self.select("?founder ?founderLabel ?school ?schoolLabel", body, 20)

    def _ways(self, a: str, b: str, forward: str, backward: str, inside: str = "") -> str:
        arm = lambda s, t, tag: f'{{ {inside} {self.fact("?relation", s, t)} OPTIONAL {{ ?relation rdfs:label ?relationLabel }} BIND("{tag}" AS ?direction) }}'
        return f"{arm(a, b, forward)} UNION {arm(b, a, backward)}"

    def pair_relations(self, first: str, second: str) -> str:
        sides = self.named(first, "?source", "?sourceLabel", both=False, cap=ops.PAIR_CANDIDATES) + self.named(second, "?target", "?targetLabel", both=False, cap=ops.PAIR_CANDIDATES)
        return self.select("?sourceLabel ?targetLabel ?relation ?relationLabel ?direction", sides + self._ways("?source", "?target", ops.FORWARD, ops.BACKWARD), 30)

    def related_people(self, name: str) -> str:
        ways = self._ways("?person", "?related", ops.OUTGOING, ops.INCOMING, f"?related a {self.p}:Person ; rdfs:label ?relatedLabel .")
        return self.select("?person ?label ?related ?relatedLabel ?relation ?relationLabel ?direction", f"{self.named(name)} {ways}", 50)

    # the templates
    def _template(self, name: str, relation: str, kind: str) -> str:
        node, label = f"?{kind}Node", f"?{kind}Label"
        body = f"{self.named(name, both=False, cap=None)} {self.fact(relation, '?person', node)} OPTIONAL {{ {node} rdfs:label {label} }}"
        return self.select(f"?person ?label {node} {label}", body, 20, False)

    def fs_courtesy(self, person: str) -> str:
        return self._template(person, "hasCourtesyName", "courtesy")

    def fs_art(self, person: str) -> str:
        return self._template(person, "hasArtName", "art")

    def fs_pair(self, a: str, b: str) -> str:
        sides = f"{self.named(a, '?source', '?sourceLabel', both=False, cap=None)} {self.named(b, '?target', '?targetLabel', both=False, cap=None)}"
        return self.select("?sourceLabel ?targetLabel ?relation ?relationLabel ?direction", self._ways("?source", "?target", ops.FORWARD, ops.BACKWARD, sides), 20, False)

    def fs_birth_death(self, person: str) -> str:
        def arm(relation: str, out: str) -> str:
            return f"OPTIONAL {{ {{ {self.fact(relation, '?person', f'?{out}Node')} {self.shown(f'?{out}Node', f'?{out}')} }} UNION {{ ?person {self.p}:{relation} ?{out}Lit . FILTER(isLiteral(?{out}Lit)) BIND(STR(?{out}Lit) AS ?{out}) }} }}"

        concat = lambda x, out: f'(GROUP_CONCAT(DISTINCT ?{x}; separator=" / ") AS ?{out})'
        body = f"{self.named(person, both=False, cap=None)} {arm('bornIn', 'birth')} {arm('diedIn', 'death')}"
        return f"{self.v.header()}\nSELECT ?person ?label {concat('birth', 'birthYear')} {concat('death', 'deathYear')} WHERE {{\n{body}\n}} GROUP BY ?person ?label LIMIT 20"

    def fs_founder(self, school: str) -> str:
        q = quoted(school)
        body = f"{self.fact('foundsSchool', '?founder', '?school')} OPTIONAL {{ ?founder rdfs:label ?founderLabel }} OPTIONAL {{ ?school rdfs:label ?schoolLabel }} FILTER(CONTAINS(STR(?schoolLabel), {q}) || CONTAINS({q}, STR(?schoolLabel)))"
        return self.select("?founder ?founderLabel ?school ?schoolLabel", body, 20, False)
