"""Instructions given to a hosted model, in this project's own words."""

FACTS_PROMPT = """Read the text below and list the lasting facts it states.
A "Earlier turns" only helps to resolve pronouns; take facts from the message itself.
Prefix attributes of past states with "former_" or "past_" so that they do not replace current ones.
Reply with a raw JSON array of objects {"attribute": snake_case string, "value": string,
"confidence_score": number from 0 to 1}, or [] if there is none.

Text:
"""

RELATIONS_PROMPT = """Read the text below and list the relations between entities it states.
Use "user" for the speaker. Reply with a raw JSON array of objects {"source_entity": string,
"target_entity": string, "relation_type": UPPER_SNAKE_CASE string, "confidence": number from 0 to 1},
or [] if there is none.

Text:
"""

CONFLICT_PROMPT = """Decide whether the candidate fact contradicts one of the existing facts.
Reply with a raw JSON object {"has_conflict": boolean, "conflicting_fact": string, "reason": string}.

"""

REFLECTION_HEAD = 'Deduce at least one implicit fact about the entity "'
REFLECTION_TAIL = """" that follows from what is listed but is not stated.
Do not repeat listed facts and do not guess. Reply with a raw JSON array of objects
{"attribute": snake_case string, "value": string, "explanation": string, "confidence": number
from 0 to 1}, or [] if nothing follows.

"""

COMMUNITY_HEAD = """Summarise the following community of connected entities, their facts and
relations as one clear, objective narrative. Reply with the summary only.

"""
