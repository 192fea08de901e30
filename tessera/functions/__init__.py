"""Column functions: contacts and addresses, money and times, message signals, extraction rules, clean-up."""
