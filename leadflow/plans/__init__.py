"""Physical-plan helpers: sessions, durable cut points, partition sizing."""
