"""Readers: one module per published list, plus requests, rules, audit events and list snapshots."""
