"""Assignment, aggregation, seeding and refinement."""
