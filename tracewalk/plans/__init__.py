"""The driver's side: packs, question grammar, plans, policy, receipts, claims."""
