"""Evidence analytics as DataFrame operators: passages, assertions, entities, graphs, reports."""
